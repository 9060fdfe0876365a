"""Registries of event windows: (name, first month, last month)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

Window = tuple[str, str, str]

#: The default registry.
DEFAULT: list[Window] = [
    ("2007 Quant Meltdown", "2007-08", "2007-09"),
    ("2008 GFC", "2008-09", "2009-03"),
    ("2010 Flash Crash", "2010-05", "2010-06"),
    ("2011 Euro Crisis", "2011-07", "2011-10"),
    ("2013 Taper Tantrum", "2013-05", "2013-07"),
    ("2015 China Crash", "2015-07", "2015-09"),
    ("2016 Brexit", "2016-06", "2016-07"),
    ("2018 Volmageddon", "2018-01", "2018-04"),
    ("2018 Q4 Selloff", "2018-10", "2018-12"),
    ("2019 Repo Crisis", "2019-09", "2019-10"),
    ("2020 COVID", "2020-02", "2020-04"),
    ("2021 Meme/Archegos", "2021-01", "2021-04"),
    ("2022 Rate Hikes", "2022-01", "2022-10"),
    ("2023 SVB", "2023-03", "2023-04"),
    ("2024 Carry Unwind", "2024-07", "2024-08"),
]

#: Windows on the calendar of the sample tables.
SAMPLE: list[Window] = [
    ("1996 Spring", "1996-03", "1996-04"),
    ("1997 Summer", "1997-07", "1997-09"),
    ("1998 Autumn", "1998-08", "1998-10"),
    ("1999 Winter", "1999-01", "1999-02"),
    ("2000 Spring", "2000-03", "2000-05"),
    ("2001 Spring", "2001-03", "2001-04"),
]

EXTEND_ROWS, BUFFER_DAYS, LEAST_HISTORY = 10, 10, 200


def get(name: str, registry: Sequence[Window] = DEFAULT) -> Window:
    for window in registry:
        if window[0] == name:
            return window
    raise KeyError(f"no window {name!r}; there are {[w[0] for w in registry]}")


def first(registry: Sequence[Window]) -> Window:
    """The window that starts first."""
    return min(registry, key=lambda w: w[1])


def frame(spark: SparkSession, registry: Sequence[Window] = DEFAULT) -> DataFrame:
    return spark.createDataFrame(list(registry), "crisis string, start_month string, end_month string")

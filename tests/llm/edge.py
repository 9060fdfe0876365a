"""Small inputs with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

BASE = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ", h long, n string, words string, block string, sig string, size string, shard int, rank string, template string, a string, b string, id string, kept string, whole_row string, z string"


def texts(seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() + ("." if rng.random() < 0.1 else "") for _ in range(n))
    long = prose(4000)
    base = prose(300)
    near = base.split()
    near[100] = "changed"
    passage = prose(70)
    line = "this line stands in several documents and is long enough to count"
    out = [
        (1, base), (2, base), (3, " ".join(near)), (4, prose(120) + "\n" + line), (5, prose(80) + "\n" + line.replace("several", "severa") + "\n" + line),
        (6, prose(60) + " " + passage + " " + prose(40)), (7, prose(30) + " " + passage + " " + prose(90)), (8, None), (9, ""), (10, " \t\n "), (11, "one"), (12, "two words"),
        (13, "Ünï cödé " * 40), (14, long), (15, long[: len(long) // 2] + " x " + long[len(long) // 2 :]), (16, "same same " * 30), (17, base.upper()), (None, base), (None, None), (18, prose(50)), (18, prose(50)), (19, "tie tie"), (19, "tie tie"),
        (20, "a\u00a0b\u2003c " + prose(25)), (21, passage), (22, "#*$%&|<> " * 20 + prose(20)),
    ]
    return out


def docs(spark, seed=0, clash=True):
    rows = []
    for i, (d, t) in enumerate(texts(seed)):
        rows.append((d, t, [None, "en", "de"][i % 3], [None, "a", "b", "a", "a"][i % 5], len(t or "")) + ((7,) + ("x",) * 5 + (3,) + ("y",) * 8 if clash else ()))
    return spark.createDataFrame(rows, BASE + (CLASH if clash else ""))


def empty(spark):
    return spark.createDataFrame([], BASE)


def word_list(text):
    return (text or "").encode().split()

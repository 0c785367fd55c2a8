import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep string, __id string, h long, label int"


def odd_rows(seed: int = 3, n: int = 60) -> list[tuple]:
    """Texts with exact and near copies, shared passages, repeated lines, nulls, empty and long texts, repeated rows."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß漢") for _ in range(r.randint(2, 6)))
    say = lambda k: " ".join(word() for _ in range(k))
    passage, line = say(90), "  Shared LINE here\t"
    texts = []
    for i in range(n):
        kind = i % 6
        t = say(r.randint(30, 160))
        if kind == 1 and texts:
            t = r.choice(texts) or ""
        elif kind == 2:
            t = f"{say(20)} {passage} {say(20)}"
        elif kind == 3:
            t = f"{line}\n{t}\n{line.lower()}\n\n{line}"
        elif kind == 4 and texts:
            w = (r.choice(texts) or "x y").split(" ")
            w[len(w) // 2] = "Changed"
            t = " ".join(w)
        texts.append(t)
    texts += [None, "", " \n\t", "one", "one", "two words", "a " * 700, "ab" * 3000, "x▁y  z", "\x00\x1f# $ | <b>", "é\u0085 end"]
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["s1", "s2", "s1", None, ""]), 1, "clash", "clash", 5, 6) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], rows[60], (None, texts[2], "en", "s1", None, None, None, None, None), (7, texts[9], None, "s9", 0, "", "", 0, 0)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

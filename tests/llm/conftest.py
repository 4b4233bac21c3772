import random

import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with nulls, empty and long texts, ties, repeated rows and columns with names that operators use."""
    r = random.Random(8)
    word = lambda: "".join(r.choice(["the", "on", "er", "ing", "sch", "ñ", "é"]) for _ in range(r.randint(1, 4)))
    para = lambda n: " ".join(word() for _ in range(n))
    shared = para(14)
    base = para(60)
    near = base.split()
    near[30] = "changed"
    texts = [None, "", " ", "a", "\n\n", para(3), base, base, " ".join(near), "x" * 3000, para(4000), "<|endoftext|> ²½ 10\x1c9 're 　 end  ", "mail a.b@c.org or +1 (414) 555-7134, 4602800807485450 at 10.0.0.255; then (414) 555-7134"]
    texts += [f"{para(30)}\n  {shared.upper() if k % 2 else shared} \n{para(5)}\n" for k in range(7)]
    rows = [(k, t, r.choice(["en", "de", None]), r.choice(["s0", None]), None if t is None else len(t), 1, "h") for k, t in enumerate(texts)]
    rows += [rows[6], rows[12], (None, base, None, None, None, None, None), (None, None, "en", "s0", 0, 0, "")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words long, sketches string").cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)

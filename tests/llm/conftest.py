import random

import pytest

#: Awkward texts: none, empty, blank, very long, odd spaces, other scripts, special strings.
ODD = [None, "", "   ", "\n\n", "a", "word " * 3000, "x" * 5000, "tab\tnew\x0bline  two   spaces \n\n end ", "日本語 テキスト ١٢٣ ½ é̀", "<|endoftext|> in <|endoftext|>text  <|endoftext|>", "it's we'll I'M 12ab ab12 …—!?", "　full wide\xa0spaces \x1c", "🙂🙃 emoji👍🏽", "\n".join(f"line{i},{i}" for i in range(3000)), "nospace" * 20000]


@pytest.fixture(scope="session")
def docs(spark):
    """Small documents with copies, near copies and awkward texts, and columns whose names clash."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "and", "Über", "naïve,", "end."]
    base = [" ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(rng.randrange(1, 120))) for _ in range(60)]
    texts = [*ODD, *base, *base[:10], *[t.replace("alpha", "omega", 1) for t in base[:30]], *[t + " tail" for t in base[20:50]]]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s0", None]), len(t or ""), i, "k", 1) for i, t in enumerate(texts)]
    rows += [rows[20], (500, None, None, None, 0, 0, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, cls long, key string, size int")
    return df.repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)

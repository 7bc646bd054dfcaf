import random

import pytest

from pinwright.llm.frames import quoted  # noqa: F401  (the package must import)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs(spark):
    """Build a documents table from (doc_id, text) pairs."""
    def build(pairs, extra=()):
        rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS)
    return build


@pytest.fixture(scope="session")
def odd_texts():
    """Empty, blank, long, tied and strange texts, and words put together at random."""
    rng = random.Random(5)
    pool = [" ", "  ", "\n", "\n\n", "\t", " \n", "\xa0", "　", "\x1c", "\x85", "\x00", "▁", "a", "the", "Hello",
            "'s", "12", "é", "中文", "😀", "<|endoftext|>", "<s>", "</s>", "<0x0A>", "...", "ﬁ", "²", "x" * 30,
            "ab" * 40, "don't", ". The", ", and"]
    made = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    prose = " ".join(rng.choice(["the", "quick", "brown", "foxes", "jump", "über", "straße,", "now."]) for _ in range(3000))
    return [None, "", " ", "\n", "a", prose, prose, "z" * 20000, "word " * 5000, *made]

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts, or from (id, text) pairs; every other column is filled in."""

    def make(texts):
        rows = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", f"s{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)], DOCS)

    return make


WORDS = "the of river stone cloud garden window music paper silver winter morning bridge yellow answer letter silent forest".split()


@pytest.fixture(scope="session")
def prose():
    import random

    def write(seed, n=80):
        rng = random.Random(seed)
        words = [rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n)]
        return " ".join(w + ("." if k % 9 == 8 else "") for k, w in enumerate(words))

    return write


def spark_hash(*values):
    """Spark's xxhash64 of longs, ints (wrapped in a list) and strings, signed; nulls are passed over."""
    import struct

    from xxhash import xxh64_intdigest

    h = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, list) else struct.pack("<q", v)
            h = xxh64_intdigest(data, h)
    return h - (1 << 64) if h >> 63 else h


@pytest.fixture(scope="session")
def xxhash64(spark):
    got = spark.sql("SELECT xxhash64(7L, 'é', 3) AS a, xxhash64(cast(null as bigint), '') AS b").first()
    assert (got.a, got.b) == (spark_hash(7, "é", [3]), spark_hash(None, ""))
    return spark_hash

"""SimHash near-duplicate classes by a segment-popcount embedding.

A fingerprint is cut into 32 segments of two bits, and each segment becomes its number of set bits, written in unary
(0, 1 or 2 as 00, 01, 11). The Manhattan distance of two such vectors is the number of differing bits of their unary
forms, and never exceeds the Hamming distance of the fingerprints. Vectors within Manhattan distance 3 agree up to 1
in one of two 16-dimensional halves, so a range join over two grids of cell width 1 finds every pair: each fingerprint
is at home in its own cell of either grid and visits that cell and those one step up. What meets is held to the
Manhattan bound first and then to the fingerprints themselves.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from xxhash import xxh64_intdigest

from bitloom.llm.common import cut, drop, frequent, join_hot, word_chunks
from bitloom.operators.sizing import small
from bitloom.llm.components import connected

SEED = 42
MAX_BITS = 3
#: Fingerprints of a cell that meet by a plain join; cells above it are dealt out in blocks.
DENSE = 64
#: Fingerprints on a side of one block pair.
BLOCK = 2048


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another 64-bit hash of the same shingles, for every k over 0, made of their first by the splitmix64 finaliser."""
    if not k:
        return h
    h = h + np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def simhashes(data: bytes, prints: int = 1, width: int = 3) -> list[int]:
    """Independent 64-bit fingerprints of one text, each by a hash of its own: a bit is set if over half of the shingles'
    hashes have it. Without words all are 0."""
    counts, total, carry = np.zeros((prints, 64), np.int64), 0, []
    votes = lambda h: np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    for words in word_chunks(data.lower()):
        words = carry + words
        shingles = zip(*(words[k:] for k in range(width)))
        h = np.fromiter(map(xxh64_intdigest, map(b" ".join, shingles), repeat(SEED)), np.uint64)
        carry = words[-(width - 1) :]
        for k in range(prints):
            counts[k] += votes(_mixed(h, k))
        total += len(h)
    if not total:
        if not carry:
            return [0] * prints
        one = np.array([xxh64_intdigest(b" ".join(carry), SEED)], np.uint64)
        return [int(_mixed(one, k)[0]) for k in range(prints)]
    return [int.from_bytes(np.packbits(c * 2 > total, bitorder="little").tobytes(), "little") for c in counts]


def simhash(data: bytes, width: int = 3) -> int:
    """The first fingerprint of one text."""
    return simhashes(data, 1, width)[0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column, prints: int = 1) -> DataFrame:
    """id and `fingerprint` (long) of docs, and more columns by expressions over id and text; then, of several prints, the
    others as fingerprint_1 and so on.

    A text that is null, empty or without words has fingerprint 0.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).select("id", *more, F.col("text").cast("binary").alias("text"))
    held = range(len(source.columns) - 1)
    out = StructType([source.schema.fields[i] for i in held])
    for name in _names(prints):
        out = out.add(name, "long", False)

    def run(batches):
        for batch in batches:
            found = np.array([simhashes(t.as_py() or b"", prints) for t in batch.column(len(held))], np.uint64).reshape(-1, prints).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in held), *(pa.array(found[:, k]) for k in range(prints))], names=out.names)

    return source.mapInArrow(run, out)


def _names(prints: int) -> list[str]:
    return ["fingerprint", *(f"fingerprint_{k}" for k in range(1, prints))]


def _unary(f: Column) -> Column:
    """Every two-bit segment's number of set bits, in unary."""
    low, half = F.lit(0x5555555555555555), F.shiftrightunsigned(f, 1)
    return f.bitwiseOR(half).bitwiseAND(low).bitwiseOR(F.shiftleft(f.bitwiseAND(half).bitwiseAND(low), 1))


def _cells(u: Column, visits: bool) -> Column:
    """(grid, cell) of the two half-vectors; with visits also the cells one step up in a dimension, else null."""
    out = []
    for grid in (0, 1):
        cell = F.shiftrightunsigned(u, 32) if grid else u.bitwiseAND(F.lit(0xFFFFFFFF))
        tag = lambda c, g=grid: c.bitwiseOR(F.lit(g << 32))
        out.append(tag(cell))
        for k in range(16) if visits else ():
            low, high = 1 << 2 * k, 2 << 2 * k
            bit = F.when(cell.bitwiseAND(F.lit(low)) == 0, F.lit(low)).when(cell.bitwiseAND(F.lit(high)) == 0, F.lit(high))
            out.append(tag(cell.bitwiseOR(bit)))
    return F.array(*out)


def _near(a: Column, b: Column) -> Column:
    """The Manhattan distance of the segments' counts as a bound, then the fingerprints' own."""
    return (F.bit_count(_unary(a).bitwiseXOR(_unary(b))) <= MAX_BITS) & (F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS)


def _unary_rows(f: np.ndarray) -> np.ndarray:
    """_unary() of an array."""
    low, half = np.uint64(0x5555555555555555), f >> np.uint64(1)
    return ((f | half) & low) | ((f & half & low) << np.uint64(1))


def _span(batches):
    """Of each (cell, block pair) a spanning forest of its links, by blocks of numpy rows."""
    from bitloom.llm.components import Forest

    for key, homes, guests in _grouped(batches):
        forest = Forest()
        counts = _unary_rows(homes)
        for k in range(0, len(guests), 256):
            part = guests[k : k + 256]
            g, h = np.nonzero(np.bitwise_count(_unary_rows(part)[:, None] ^ counts[None, :]) <= MAX_BITS)
            apart = np.bitwise_count(part[g] ^ homes[h])
            kept = (apart <= MAX_BITS) & (apart > 0)
            g, h = g[kept], h[kept]
            for x, y in zip(part[g].view(np.int64).tolist(), homes[h].view(np.int64).tolist()):
                forest.join(x, y)
        links = forest.links
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])


def _grouped(batches):
    """(key, homes, guests) of runs of equal (cell, i, j); a run holds BLOCK rows a side or little more."""
    key, homes, guests = None, [], []
    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
        for cell, i, j, home, f in zip(*(c.tolist() for c in cols)):
            if (cell, i, j) != key:
                if homes and guests:
                    yield key, np.array(homes, np.int64).view(np.uint64), np.array(guests, np.int64).view(np.uint64)
                key, homes, guests = (cell, i, j), [], []
            (homes if home else guests).append(f)
    if homes and guests:
        yield key, np.array(homes, np.int64).view(np.uint64), np.array(guests, np.int64).view(np.uint64)


def links(prints: DataFrame) -> DataFrame:
    """(a, b) links of distinct fingerprints, a column `fingerprint`, at MAX_BITS differing bits or fewer.

    Cells with up to DENSE homes give every link. Denser ones are cut into block pairs of BLOCK fingerprints, each of
    which gives a spanning forest of its links: the classes are the same, and the rows stay in proportion.
    """
    base = prints.select(F.col("fingerprint").alias("f"))
    homes = base.select("f", F.explode(_cells(_unary(F.col("f")), False)).alias("cell"))
    guests = base.select("f", F.explode(F.array_compact(_cells(_unary(F.col("f")), True))).alias("cell"))
    dense = cut(homes.groupBy("cell").count().where(F.col("count") > DENSE))
    h, g = homes.alias("h"), guests.alias("g")
    plain = (
        g.join(dense, "cell", "left_anti").alias("g")
        .join(h, (F.col("g.cell") == F.col("h.cell")) & (F.col("g.f") != F.col("h.f")) & _near(F.col("g.f"), F.col("h.f")))
        .select(F.col("g.f").alias("a"), F.col("h.f").alias("b"))
    )
    if dense.isEmpty():
        return plain
    crowd = dense.select("cell", F.ceil(F.col("count") / BLOCK).alias("nh"))
    in_dense = guests.join(crowd, "cell").select("cell", "nh", "f")
    crowd = in_dense.groupBy("cell", "nh").agg(F.ceil(F.count("*") / BLOCK).alias("ng"))
    deal = lambda n: F.pmod(F.xxhash64(F.col("f"), F.lit(7)), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    home_rows = homes.join(crowd, "cell").select("cell", deal(F.col("nh")).alias("i"), every(F.col("ng")).alias("j"), F.lit(True).alias("home"), "f")
    guest_rows = guests.join(crowd, "cell").select("cell", every(F.col("nh")).alias("i"), deal(F.col("ng")).alias("j"), F.lit(False).alias("home"), "f")
    blocks = home_rows.unionByName(guest_rows.select("cell", "i", "j", "home", "f"))
    spanned = blocks.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(_span, "a long, b long")
    return plain.unionByName(spanned)


def classes(prints: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(fingerprint, component_id, root): of every distinct fingerprint, the smallest id that links lead to, and its class.

    root tells classes apart where rows of two share an id. prints: one row a document, with its id and `fingerprint`.
    """
    return _classes_of(cut(prints.groupBy("fingerprint").agg(F.min(id_col).alias("own_id"))))


def _all_links(own: DataFrame, others: list[str]) -> DataFrame:
    """links() of the fingerprints of own, and those by its other prints, as links of first fingerprints: another print that
    is the same, or near, links the texts that have it. own: the prints of every distinct text."""
    out = links(own.select("fingerprint").distinct())
    for name in others:
        pairs = cut(own.select(F.col(name).alias("o"), "fingerprint").distinct())
        least = cut(pairs.groupBy("o").agg(F.min("fingerprint").alias("rep")))
        near = links(least.select(F.col("o").alias("fingerprint")))
        near = near.join(least.select(F.col("o").alias("a"), F.col("rep").alias("x")), "a").join(least.select(F.col("o").alias("b"), F.col("rep").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        same = pairs.join(least, "o").select(F.col("fingerprint").alias("a"), F.col("rep").alias("b"))
        out = out.unionByName(near).unionByName(same)
    return out.where("a != b")


def _classes_of(own: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """classes() of distinct fingerprints with their least ids, `own_id`: equal ones have met before any join. edges: their
    links, if not those of links()."""
    found = connected(links(own) if edges is None else edges)
    linked = cut(own.join(found.select(F.col("node").alias("fingerprint"), "root"), "fingerprint", "left").select("fingerprint", "own_id", F.coalesce("root", "fingerprint").alias("root"), F.col("root").isNotNull().alias("moved")))
    # ids of a class meet once a map task has taken the least of its own
    least = linked.where("moved").unionByName(linked.where("not moved").join(found.select("root").distinct(), "root", "left_semi")).groupBy("root").agg(F.min("own_id").alias("component_id"), F.count("*").alias("rows"))
    # few classes have many fingerprints; classes of one fingerprint need none of this
    n = linked.where("moved").count()
    least = cut(least)
    met = join_hot(linked.where("moved"), least.select("root", "component_id"), "root", least.where(F.col("rows") > frequent(n)))
    alone = linked.where("not moved").join(least.select("root", "component_id"), "root", "left")
    out = met.unionByName(alone.select(*met.columns))
    return out.select("fingerprint", F.coalesce("component_id", "own_id").alias("component_id"), "root")


def dedup_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, `fingerprint` (16 hex digits) and `component_id`.

    Empty, null and wordless texts share fingerprint 0 and so link. Repeated rows give repeated rows. Ids may be null:
    such rows are kept, and a class of nothing else has a null component_id. An empty table gives none; other columns
    don't matter, whatever their names.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    own = cut(prints.groupBy("fingerprint").agg(F.min("id").alias("own_id"), F.count("*").alias("rows")))
    found = _classes_of(own.select("fingerprint", "own_id")).select("fingerprint", "component_id")
    n = prints.count()
    out = join_hot(prints, found, "fingerprint", own.where(F.col("rows") > frequent(n)))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


#: Rows of a table of dropped documents (an id and two hashes each) that may be broadcast.
FEW_DROPPED = 500_000
#: Independent fingerprints by which keep_first() links.
PRINTS = 2


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prints: int = PRINTS) -> DataFrame:
    """docs with one row of each class: that of its smallest id, the rest of its rows dropped. Columns stay as they are,
    whatever their names.

    Texts link if any of several independent fingerprints differ in MAX_BITS bits or fewer: a near copy that one print
    misses, another may find.

    Rows that repeat an id are told apart by fingerprint and then text (by two 64-bit hashes), and of rows that agree in
    all these the least by its other columns stays, so exactly one row of a class remains. Null ids come after all others.
    Texts are read once for fingerprints, and classes are made of ids, fingerprints and hashes; texts aren't shuffled
    unless too many rows go for a broadcast of their keys.
    """
    numbered = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    id_at, text_at = f"c{docs.columns.index(id_col)}", f"c{docs.columns.index(text_col)}"
    hashes = lambda text: (F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"))
    others = _names(prints)[1:]
    found = cut(fingerprints(numbered, id_at, text_at, *hashes(F.col("text")), prints=prints))
    keys = cut(found.groupBy("fingerprint", "id", "h", "g").agg(F.count("*").alias("rows")))
    best = keys.groupBy("fingerprint").agg(F.min("id").alias("own_id"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fingerprint", "h", "g")).alias("best"))
    best = cut(best)
    every = found.groupBy("fingerprint", *others).count().drop("count")
    edges = _all_links(cut(every), others)
    first = best.join(_classes_of(best.select("fingerprint", "own_id"), edges).select("fingerprint", "root"), "fingerprint").groupBy("root").agg(F.min("best").alias("best"))
    first = first.select(F.col("best.fingerprint").alias("fingerprint"), F.col("best.id").alias("id"), F.col("best.h").alias("h"), F.col("best.g").alias("g"))
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["h"] == b["h"]) & (a["g"] == b["g"])
    k, f = keys.alias("k"), first.alias("f")
    met = (F.col("k.fingerprint") == F.col("f.fingerprint")) & F.col("k.id").eqNullSafe(F.col("f.id")) & (F.col("k.h") == F.col("f.h")) & (F.col("k.g") == F.col("f.g"))
    kept = k.join(f, met, "left_semi").where("rows > 1")
    gone = cut(k.join(f, met, "left_anti").select("id", "h", "g").unionByName(kept.select("id", "h", "g")))
    gone_few = small(gone, FEW_DROPPED)
    rows = numbered.select("*", F.col(id_at).alias("id"), *hashes(F.col(text_at)))
    single = rows.join(gone_few, same(rows, gone_few), "left_anti").select(*numbered.columns)
    # what is kept of repeated rows: met in one row each by a map-side aggregate
    again = cut(kept.select("id", "h", "g"))
    if again.isEmpty():
        return single.toDF(*docs.columns)
    again = small(again, FEW_DROPPED)
    repeated = rows.join(again, same(rows, again), "left_semi").groupBy("id", "h", "g").agg(F.min(F.struct(*numbered.columns)).alias("row")).select("row.*")
    return single.unionByName(repeated).toDF(*docs.columns)

"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint is cut into just enough segments that, of two fingerprints
within the bit limit, one segment differs by at most one bit. Every segment is
indexed under each of its variants with one bit masked out; equal variants
meet in an equality join and the whole distance is verified.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import map_batches, raw_texts, slices, stored
from quire.llm.components import connected_components

BITS = 64
#: Distinct fingerprints under one variant up to which they are paired directly; larger variants are indexed once more.
DIRECT = 64
SEED = 42


def shingle_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 of every word shingle of the text with A-Z lower-cased; a shorter text is one shingle."""
    words = text.lower().split()
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return [digest(join(s), SEED) for s in zip(*(words[i:] for i in range(size)))]


def _fingerprints(hashes: list[list[int]]) -> np.ndarray:
    out = np.zeros(len(hashes), np.int64)
    flat = np.fromiter((h for row in hashes for h in row), np.uint64)
    bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at = 0
    for i, row in enumerate(hashes):
        if row:
            ones = bits[at:at + len(row)].sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(2 * ones > len(row), bitorder="little").view(np.int64)[0]
            at += len(row)
    return out


def _text_hash(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, text_hash, fp) for every row; fp is the 64-bit fingerprint as a long, zero for a text without words or a
    null text, and text_hash tells texts apart."""
    src = docs.select(F.col(id_col).alias("id"), _text_hash(F.col(text_col)).alias("text_hash"),
                      F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in slices(batches, "text"):
            fp = _fingerprints([shingle_hashes(t, shingle) for t in raw_texts(batch, "text")])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_hash"), pa.array(fp)],
                                             names=["id", "text_hash", "fp"])

    return map_batches(src, run, f"id {src.schema['id'].dataType.simpleString()}, text_hash long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest segments of which one differs by at most one bit."""
    n = max_bits // 2 + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _segment_mask(first: int, width: int) -> int:
    return ((1 << width) - 1) << first


def _near(max_bits: int) -> Column:
    return F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits


def _paired(rows: DataFrame, keys: list[str]) -> DataFrame:
    left = rows.withColumnRenamed("fp", "a")
    right = rows.withColumnRenamed("fp", "b")
    return left.join(right, keys).where(F.col("a") < F.col("b")).select("a", "b")


def links(fps: DataFrame, max_bits: int, direct: int = DIRECT) -> DataFrame:
    """Distinct pairs a < b of the distinct fingerprints ``fp`` (longs) that differ in at most ``max_bits`` bits.

    All variants are shuffled once, to count who shares them. Those shared by
    2 to ``direct`` fingerprints are joined with themselves. Larger ones are
    indexed again: outside the segment, ``max_bits`` bits are
    masked in every way, and at most 2 ** (max_bits + 1) fingerprints agree on
    what is left, so work stays in proportion to the rows and no link is lost.
    """
    spread = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fps = fps.select("fp").where(F.col("fp").isNotNull()).repartition(spread, "fp").distinct()
    if max_bits < 1:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where(F.lit(False))
    parts = segments(max_bits)
    variants = []
    for first, width in parts:
        for bit in range(first, first + width):
            mask = _signed(_segment_mask(first, width) & ~(1 << bit))
            variants.append(F.struct(F.lit(bit).cast("byte").alias("bit"),
                                     F.col("fp").bitwiseAND(F.lit(mask)).alias("key")))
    indexed = fps.select("fp", F.explode(F.array(*variants)).alias("k")).select("k.bit", "k.key", "fp")
    size = F.count("*").over(Window.partitionBy("bit", "key"))
    shared = stored(indexed.select("*", size.alias("n")).where("n > 1"), "variants")
    found = _paired(shared.where(F.col("n") <= direct).drop("n"), ["bit", "key"])
    large = shared.where(F.col("n") > direct).drop("n")
    finer = F.lit(None)
    for first, width in parts:
        outside = [b for b in range(BITS) if not first <= b < first + width]
        rest = ((1 << BITS) - 1) ^ _segment_mask(first, width)
        masks = [_signed(rest & ~sum(1 << b for b in c)) for c in combinations(outside, min(max_bits, len(outside)))]
        finer = F.when(F.col("bit").between(first, first + width - 1), F.lit(np.array(masks, np.int64))).otherwise(finer)
    again = (large.select("bit", "key", "fp", F.posexplode(finer).alias("way", "mask"))
             .select("bit", "key", "way", F.col("fp").bitwiseAND(F.col("mask")).alias("rest"), "fp"))
    if not large.isEmpty():
        found = found.unionByName(_paired(again, ["bit", "key", "way", "rest"]))
    return found.where(_near(max_bits)).distinct()


def _named(fp: DataFrame, max_bits: int) -> DataFrame:
    """(fp, component, component_id) of each fingerprint, stored. Components that share an id can share component_id."""
    nodes = stored(fp.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    parts = connected_components(links(nodes, max_bits))
    label = (nodes.join(parts, nodes["fp"] == parts["node"], "left")
             .select("fp", "first", F.coalesce("component", "fp").alias("component")))
    least = label.groupBy("component").agg(F.min("first").alias("component_id"))
    return stored(label.join(least, "component").select("fp", "component", "component_id"), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 2) -> DataFrame:
    """(id, fp, component_id) for every row: component_id is the least id reachable over links of at most max_bits.

    Equal fingerprints are one node, so copies never make pairs. Rows without a
    word, null texts included, share fingerprint zero. A null id takes part in
    its component but never names it while another id does. Repeated rows come
    back as often as they came; an empty table gives an empty result.
    """
    fp = stored(fingerprints(docs, id_col, text_col, shingle).select("id", "fp"), "fingerprints")
    return fp.join(_named(fp, max_bits), "fp").select("id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                max_bits: int = 2) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each near-duplicate component: that of the least id,
    and of that id's texts the one of least hash.

    Of rows that repeat an id and a text, the one whose columns have the least hash stays. Rows without an id are
    copies of each other only: one of each component stays, beside that with an id.
    """
    fp = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    named = _named(fp, max_bits).select("fp", "component")
    rows = fp.groupBy("id", "text_hash").agg(F.min("fp").alias("fp"), F.count("*").alias("n"))
    no_id, least = F.col("id").isNull().alias("no_id"), F.min(F.struct("id", "text_hash", "n")).alias("least")
    by_fp = rows.groupBy("fp", no_id).agg(least).select("fp", "no_id", "least.*")
    found = stored(by_fp.join(named, "fp").groupBy("component", "no_id").agg(least)
                   .select("least.id", "least.text_hash", "least.n").distinct(), "kept")

    def among(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        same_text = _text_hash(docs[text_col]) == keys["text_hash"]
        return df.join(keys, docs[id_col].eqNullSafe(keys["id"]) & same_text, how)

    # by a sort-merge join at every size, so that the plan does not change with the number of ids
    kept = among(docs, found.select("id", "text_hash").hint("merge"), "left_semi")
    again = found.where("n > 1").select("id", "text_hash")
    if again.isEmpty():
        return kept
    # columns by place, as names may be odd or come twice
    several = among(kept, again, "left_semi")
    plain = several.toDF(*[f"c{i}" for i in range(len(several.columns))])
    keys = [plain.columns[several.columns.index(c)] for c in (id_col, text_col)]
    first = F.min_by(F.struct(*plain.columns), F.xxhash64(*plain.columns)).alias("first")
    one = plain.groupBy(*keys).agg(first).select("first.*").toDF(*several.columns)
    return among(kept, again, "left_anti").unionByName(one)


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")

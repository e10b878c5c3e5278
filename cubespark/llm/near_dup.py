"""Near duplicates by b-bit MinHash, with links confirmed on full sets.

A text's set is its distinct five-word shingles. Permutations, 352 at most, give its minima.
Bands of minima name the buckets it falls into; their number and length follow from the
limit, so that two sets as similar as that share none with a chance below 1e-6: 44 bands of
eight for 0.85, 48 of six for 0.8. Of each minimum the low four bits
are kept and packed; the share of equal ones, corrected for chance matches, estimates
the similarity of two candidates, and pairs five standard errors below the limit are left.

Texts with equal sets are one node. Pairs within a bucket are not all listed:

1. each member is paired with the one member of its buckets that shares most buckets with
   others; pairs are confirmed and give first components;
2. pairs of members in different components so far are compared by their packed bits, in
   blocks of bounded size. Members of a bucket's largest component meet only those of others.
   Members that may have a link get their full sets and meet again in their blocks, where
   pairs are confirmed, the closest first. A block gives the links that connect its
   components and not its pairs, of which there may be as many as the square of its members.

Pairs that are already connected add nothing to a component, so none is lost. A task holds the
sets of two blocks, 2 * ``BLOCK`` at most.

Null and empty texts have no shingles and link with nothing. Ids are whole numbers; an id that
is none counts as null. Rows without an id are not linked: component null, kept. Rows that share
an id count as linked. Repeated rows have one node and are compared once. An empty table gives
an empty one. Texts are hashed in pieces of some rows; a long text is a piece of its own, and
memory grows with it. Columns besides id and text are not read. ``keep_one`` leaves one row of
each group of similar texts, whatever their ids, with all its columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubespark.llm.batches import mixed, pieces, shingle_hashes, text_bytes, word_hashes
from cubespark.llm.components import components
from cubespark.llm.steps import Steps, small

MINIMA, BITS, MISSED = 352, 4, 1e-6
LIMIT = (85, 100)
ERRORS = 5.0
BLOCK = 512
_draw = np.random.default_rng(17)
FACTORS = _draw.integers(0, 1 << 31, MINIMA, np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _draw.integers(0, 1 << 32, MINIMA, np.uint32)


class Banding(NamedTuple):
    """How many bands of how many minima each, for links of a similarity of at least ``limit``."""

    limit: tuple[int, int]
    bands: int
    rows: int

    @property
    def minima(self) -> int:
        return self.bands * self.rows

    def least_matches(self) -> int:
        """Equal low bits below which a pair is no candidate."""
        chance = 2.0**-BITS
        match = chance + (1 - chance) * self.limit[0] / self.limit[1]
        return int(self.minima * match - ERRORS * (self.minima * match * (1 - match)) ** 0.5)


def banding(limit: tuple[int, int] = LIMIT) -> Banding:
    """The longest bands that miss a pair at the limit with a chance of ``MISSED`` at most."""
    j = limit[0] / limit[1]
    if not 0 < j <= 1:
        raise ValueError(f"a limit is above 0 and at most 1, not {limit[0]} / {limit[1]}")
    for rows in range(8, 0, -1):
        bands = 1 if j == 1 else math.ceil(math.log(MISSED) / math.log1p(-(j**rows)))
        while bands * rows % 16:  # packed words are full
            bands += 1
        if bands * rows <= MINIMA:
            return Banding(limit, bands, rows)
    raise ValueError(f"{MINIMA} minima are too few for a limit of {limit[0]} / {limit[1]}")


def distinct_sets(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text in a row, and where each text's begin."""
    words, bounds = word_hashes(flat, offsets)
    hashes, rows = shingle_hashes(words, bounds)
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[new], rows[new]
    return hashes, np.searchsorted(rows, np.arange(len(offsets)))


def minima(hashes: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """Minima (texts x permutations) of the texts that have shingles."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((count, len(starts)), np.uint32)
    for i in range(count):
        np.minimum.reduceat(x * FACTORS[i] + SHIFTS[i], starts, out=out[i])
    return np.ascontiguousarray(out.T)


def band_keys(m: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.zeros((len(m), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    parts = m.reshape(len(m), bands, rows).astype(np.uint64)
    for i in range(rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key


def packed(m: np.ndarray) -> np.ndarray:
    """Low bits of the minima, sixteen to a word."""
    low = (m & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(m), m.shape[1] // 16, 16)
    return np.bitwise_or.reduce(low << (np.arange(16, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def _id_kind(df: DataFrame) -> str:
    return df.schema["id"].dataType.simpleString()


def sketches(docs: DataFrame, n_bands: int, n_rows: int) -> DataFrame:
    """(id, n_shingles, digest of the set, bands, packed bits) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = text_bytes(batch, "text")
            for low, high in pieces(offsets):
                hashes, bounds = distinct_sets(flat, offsets[low : high + 1])
                counts = np.diff(bounds)
                some = np.flatnonzero(counts > 0)
                m = minima(hashes, bounds, n_bands * n_rows)
                digests: list = [None] * len(counts)
                bands: list = [None] * len(counts)
                bits: list = [None] * len(counts)
                for row, keys, word in zip(some, band_keys(m, n_bands, n_rows).view(np.int64), packed(m).view(np.int64)):
                    digests[row] = xxhash.xxh3_128_digest(hashes[bounds[row] : bounds[row + 1]])
                    bands[row], bits[row] = keys, word
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(low, high - low),
                        pa.array(counts, pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                        pa.array(bits, pa.list_(pa.int64())),
                    ],
                    names=["id", "n_shingles", "digest", "bands", "bits"],
                )

    schema = f"id {_id_kind(docs)}, n_shingles bigint, digest binary, bands array<bigint>, bits array<bigint>"
    return docs.mapInArrow(run, schema)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(id, set) with the sorted distinct shingle hashes of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = text_bytes(batch, "text")
            for low, high in pieces(offsets):
                hashes, bounds = distinct_sets(flat, offsets[low : high + 1])
                sets = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(low, high - low), sets], names=["id", "set"])

    return docs.mapInArrow(run, f"id {_id_kind(docs)}, set array<bigint>")


def _unequal(x: Column, y: Column) -> Column:
    """How many packed values differ."""

    def unequal(a: Column, b: Column) -> Column:
        d = a.bitwiseXOR(b)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        return F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))

    return F.aggregate(F.zip_with(x, y, unequal), F.lit(0), lambda s, v: s + v)


def _confirmed(pairs: DataFrame, sets: DataFrame, limit: tuple[int, int]) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - shared
    return pairs.join(right, "b").join(left, "a").where(shared * limit[1] >= union * limit[0]).select("a", "b")


MEMBER = ("group", "band", "block", "node", "label", "bits", "bands")


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[dict[str, list]]:
    """The named columns of two members or more that come in a row and share their group; ``set`` as arrays."""
    held: list[tuple] = []
    key = None
    for batch in batches:
        columns = [_sets(batch.column(n)) if n == "set" else batch.column(n).to_pylist() for n in names]
        for row in zip(*columns):
            if row[0] != key:
                if len(held) > 1:
                    yield dict(zip(names, zip(*held)))
                held, key = [], row[0]
            held.append(row)
    if len(held) > 1:
        yield dict(zip(names, zip(*held)))


def _sets(column: pa.ListArray) -> list[np.ndarray]:
    values, at = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
    return [values[low:high] for low, high in zip(at[:-1], at[1:])]


def _close(rows: dict[str, list], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members of two blocks that are in different components, ``most`` of whose packed values differ; how many do."""
    node, label, block, bands = (np.array(rows[n], np.int64) for n in ("node", "label", "block", "bands"))
    bits = np.array(rows["bits"], np.int64).view(np.uint64)
    left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    unequal = np.zeros((len(left), len(right)), np.uint16)
    for k in range(bits.shape[1]):
        d = bits[left, k][:, None] ^ bits[right, k][None, :]
        d |= d >> np.uint64(1)
        d |= d >> np.uint64(2)
        unequal += np.bitwise_count(d & np.uint64(0x1111111111111111))
    i, j = np.nonzero((unequal <= most) & (label[left][:, None] != label[right][None, :]))
    n = unequal[i, j]
    i, j = left[i], right[j]
    # a pair that shares several bands counts in the first of them, and once in a block of its own
    here = bands[i, np.argmax(bands[i] == bands[j], 1)] == rows["band"][0]
    if block.min() == block.max():
        here &= node[i] < node[j]
    return i[here], j[here], n[here]


def _close_members(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The members of each group that are in a close pair."""
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    for rows in _groups(batches, MEMBER):
        i, j, _ = _close(rows, most)
        some = np.union1d(i, j).tolist()
        yield pa.RecordBatch.from_arrays([pa.array([rows[n][k] for k in some], t) for n, t in zip(MEMBER, kinds)], names=list(MEMBER))


def _close_links(batches: Iterator[pa.RecordBatch], most: int, limit: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """The links that connect the components of each group's members, confirmed on full sets."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for rows in _groups(batches, (*MEMBER, "set")):
        node, label, sets = rows["node"], rows["label"], rows["set"]
        i, j, unequal = _close(rows, most)
        sizes = np.array([len(x) for x in sets])
        able = np.minimum(sizes[i], sizes[j]) * limit[1] >= np.maximum(sizes[i], sizes[j]) * limit[0]
        i, j, unequal = i[able], j[able], unequal[able]
        order = np.argsort(unequal, kind="stable")
        above = {x: x for x in label}

        def root(x: int) -> int:
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        links = []
        for a, b in zip(i[order].tolist(), j[order].tolist()):
            x, y = root(label[a]), root(label[b])
            if x == y:
                continue
            few, many = sorted((sets[a], sets[b]), key=len)
            shared = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())
            if shared * limit[1] >= (len(few) + len(many) - shared) * limit[0]:
                above[x] = y
                links.append((node[a], node[b]))
        yield pa.RecordBatch.from_arrays([pa.array([k[n] for k in links], pa.int64()) for n in (0, 1)], schema=schema)


def near_duplicates(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", limit: tuple[int, int] = LIMIT
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row; ``limit`` is the least similarity of a link, as a fraction."""
    plan = banding(limit)
    most = plan.minima - plan.least_matches()
    kept = Steps(df.sparkSession).kept
    docs = df.select(F.col(id_column).try_cast("long").alias("id"), F.col(text).alias("text"))
    # rows are numbered, so that one of several equal ones can be named
    sketched = kept(sketches(docs, plan.bands, plan.rows).withColumn("row", F.monotonically_increasing_id()), "sketches")
    known = sketched.where("id is not null and digest is not null")
    by_set = known.groupBy("digest").agg(F.min(F.struct("id", "row")).alias("first"))
    by_set = kept(by_set.select("digest", F.col("first.id").alias("node"), F.col("first.row").alias("first")), "sets")
    # one row of each set; rows that share an id may have several sets, each a node of that name
    nodes = known.join(by_set, "digest").where("row = first").select("node", "bands", "bits")
    # only numbers are shuffled per band; packed bits join the pairs that are left
    by_band = nodes.select("node", F.explode("bands").alias("band"))
    shared = by_band.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = kept(by_band.join(shared, "band"), "members")

    # 1. each member with the best connected one of all its buckets: a pair per node, however many
    # buckets a group of copies shares
    degrees = members.groupBy("node").agg(F.sum("n").alias("degree"))
    rank = F.struct("degree", (-F.col("node")).alias("first"))
    best = members.join(degrees, "node").groupBy("band").agg(F.max(rank).alias("best"))
    stars = members.join(best, "band").groupBy("node").agg(F.max("best").alias("best"))
    stars = stars.select(F.col("node").alias("a"), (-F.col("best.first")).alias("b")).where("a <> b")
    bits = nodes.select("node", "bits")
    stars = (
        stars.join(bits.withColumnsRenamed({"node": "a", "bits": "bits_a"}), "a")
        .join(bits.withColumnsRenamed({"node": "b", "bits": "bits_b"}), "b")
        .where(_unequal(F.col("bits_a"), F.col("bits_b")) <= most)
        .select("a", "b")
    )
    stars = kept(stars, "stars")
    texts = docs.where("id is not null")
    ends = stars.select(F.col("a").alias("id")).union(stars.select(F.col("b").alias("id"))).distinct()
    links = kept(_confirmed(stars, _sets_of(texts, ends), limit), "links")
    first = components(links)

    # 2. members of a bucket in different components so far
    labelled = members.join(first, "node", "left").withColumn("label", F.coalesce("label", "node"))
    counts = labelled.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n_label"))
    # members of the bucket's largest component meet the others, not one another
    mixed_bands = counts.groupBy("band").agg(
        F.max_by("label", F.struct("n_label", "label")).alias("main"), F.max("n_label").alias("n_main"), F.sum("n_label").alias("n_all")
    )
    mixed_bands = kept(mixed_bands.where("n_all > n_main"), "mixed-buckets")
    left = labelled.drop("n").join(mixed_bands, "band").join(nodes, "node")
    minor = F.col("label") != F.col("main")
    minor_blocks = F.ceil((F.col("n_all") - F.col("n_main")) / BLOCK).cast("int")
    main_blocks = F.ceil(F.col("n_main") / BLOCK).cast("int")
    own = F.when(minor, F.pmod(F.xxhash64("node"), minor_blocks)).otherwise(minor_blocks + F.pmod(F.xxhash64("node"), main_blocks))
    last = F.when(minor, minor_blocks + main_blocks).otherwise(minor_blocks)
    other = F.explode(F.sequence(F.lit(0), last - 1))
    spread = left.select("band", "node", "label", "bits", "bands", own.cast("int").alias("block"), other.alias("other")).select(
        F.concat_ws("/", "band", F.least("block", "other"), F.greatest("block", "other")).alias("group"),
        "band",
        "block",
        "node",
        "label",
        "bits",
        "bands",
    )
    met = spread.repartition("group").sortWithinPartitions("group")
    member = "group string, band bigint, block int, node bigint, label bigint, bits array<bigint>, bands array<bigint>"
    close = kept(met.mapInArrow(lambda batches: _close_members(batches, most), member), "close")
    full = close.join(_sets_of(texts, close.select(F.col("node").alias("id")).distinct()), "node").select(*MEMBER, "set")
    full = full.repartition("group").sortWithinPartitions("group")
    more = kept(full.mapInArrow(lambda batches: _close_links(batches, most, limit), "a bigint, b bigint"), "more-links")
    named_labels = first.select(F.col("node").alias("a"), F.col("label").alias("b"))
    final = components(more.union(named_labels))

    node_of = known.join(by_set, "digest").select("id", "node").distinct()
    # rows that share an id tie their sets together
    repeated = node_of.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    if repeated.limit(1).count():
        tied = node_of.join(repeated.select("id"), "id").select(F.col("id").alias("a"), F.col("node").alias("b"))
        final = components(final.select(F.col("node").alias("a"), F.col("label").alias("b")).union(tied))
    labels = node_of.groupBy("id").agg(F.min("node").alias("node")).join(final, "node", "left").select(
        F.col("id").alias("_id"), F.coalesce("label", "node").alias("label")
    )
    out = sketched.select("id", "n_shingles").join(labels, F.col("id") == F.col("_id"), "left")
    component = F.coalesce("label", "id")
    return out.select(
        F.col("id").alias(id_column),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _sets_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Full sets of nodes, from their texts."""
    wanted = texts.join(small(nodes, nodes.count()), "id", "left_semi")
    # of repeated rows one is enough
    wanted = wanted.withColumn("body", F.xxhash64("text")).dropDuplicates(["id", "body"]).drop("body")
    return shingle_sets(wanted).withColumnRenamed("id", "node")


def keep_one(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", limit: tuple[int, int] = LIMIT
) -> DataFrame:
    """One row of each component, with all its columns; that of the smallest id, those without an id last.

    Texts alone link here. A row's name is its id, or a hash of its text where it has no id or
    its id has several texts: so rows without an id go as well if their text is there already,
    and a text stays that only shares its id with others. Repeated rows leave one of them. Rows
    without an id and without shingles have nothing to compare and all stay.
    """
    kept = Steps(df.sparkSession).kept
    own = df.select(F.col(id_column).try_cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    texts = F.xxhash64("_text")
    several = own.where("_id is not null").groupBy("_id").agg(F.min(texts).alias("lo"), F.max(texts).alias("hi"))
    several = kept(several.where("lo <> hi").select(F.col("_id").alias("_several")), "ids-of-several-texts")
    several = small(several, several.count())

    def named(rows: DataFrame, id_: Column, text_: Column) -> DataFrame:
        # behind usual ids, so that the smallest name is an id if there is one
        by_text = F.xxhash64(F.lit("text"), F.coalesce(text_, F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
        rows = rows.withColumn("_id", id_.try_cast("long")).join(several, F.col("_id") == F.col("_several"), "left")
        name = F.when(F.col("_id").isNull() | F.col("_several").isNotNull(), by_text).otherwise(F.col("_id"))
        return rows.withColumn("_name", name).drop("_several")

    # the rows are one column, whatever their columns are called
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    rows = named(packed, F.col("_row")[id_column], F.col("_row")[text])
    keys = kept(rows.groupBy("_id", "_name").agg(F.count(F.lit(1)).alias("_n")), "row-names")
    found = near_duplicates(rows.select("_name", F.col("_row")[text].alias("_text")), "_name", "_text", limit)
    # rows of one name have one text
    found = found.groupBy("_name").agg(F.max("n_shingles").alias("_size"), F.min("component_id").alias("_component"))
    keys = kept(keys.join(found, "_name").where("_id is not null or _size > 0"), "row-components")
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_name").alias("name"))
    firsts = keys.groupBy("_component").agg(F.min(order).alias("_first"))
    marked = keys.join(firsts, "_component").withColumn("_stays", F.col("_id").eqNullSafe(F.col("_first.id")) & (F.col("_name") == F.col("_first.name")))
    marked = marked.select(F.col("_id").alias("_own"), F.col("_name").alias("_own_name"), "_n", "_stays")
    marked = kept(marked.where("not _stays or _n > 1"), "near-duplicates")
    marked = small(marked, marked.count())
    same = F.col("_id").eqNullSafe(F.col("_own")) & (F.col("_name") == F.col("_own_name"))
    single = rows.join(marked, same, "left_anti")
    # one of each set of repeated rows; aggregation combines them in the tasks, so none is hot
    tied = rows.join(marked.where("_stays"), same, "left_semi").dropDuplicates(["_id", "_name"])
    return single.union(tied).select("_row.*")


ORACLE_SQL = r"""
with recursive doc_words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') as w from documents),
sets as materialized (
  select distinct doc_id, unnest(case when len(w) >= 5
    then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from doc_words),
sizes as materialized (select doc_id, count(*) as n from sets group by doc_id),
links as materialized (
  select x.doc_id as a, y.doc_id as b
  from sets x join sets y on x.s = y.s and x.doc_id <> y.doc_id
  join sizes m on m.doc_id = x.doc_id join sizes n on n.doc_id = y.doc_id
  group by x.doc_id, y.doc_id, m.n, n.n having 100 * count(*) >= 85 * (m.n + n.n - count(*))),
reach(doc_id, other) as (
  select doc_id, doc_id from documents
  union select reach.doc_id, links.b from reach join links on links.a = reach.other),
parts as (select doc_id, min(other) as component_id from reach group by doc_id)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from documents d join parts using (doc_id) left join sizes using (doc_id)
"""

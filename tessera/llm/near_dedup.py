"""Near-duplicate detection by Order MinHash, verified by banded alignment.

Likeness.  A text is the sequence of its runs of five words (one run of all words, if fewer).  With *m* runs in the
longest common subsequence of two texts of *n1* and *n2* runs, their likeness is m / (n1 + n2 - m): the Jaccard
similarity of the runs that also respects their order.  Texts of likeness 0.8 or more are linked; classes are the
connected components of links.  Texts without words are alike only when equal.

Candidates.  Each run is labelled with its occurrence number in the text.  A sketch takes the ``TAKE`` runs with the
smallest hashes under one permutation and keeps their text order; texts with equal sketches share a bucket.  There are
``SKETCHES`` permutations.  Texts of up to ``SHORT_TO`` runs also (those below ``LONG_FROM`` only) have sketches of two
runs.  A pair at the threshold shares no sketch, and may be missed, with a probability of up to 3.7e-4 where the longer text
has 25 to 40 runs (2.7e-4 for two texts of 27, with 24 runs in common of 30), 1.6e-4 at 41 to 64, 1.2e-4 at 65 to 130
and below 1e-4 otherwise.

Verification.  Equal texts are one node.  In each bucket one member, the same in most of a group's buckets, is
aligned with all others (a star), in all buckets at once; classes of the links found are formed, and further stars
around other members join what still differs, while many texts are left.  What remains are buckets of several classes.  All their members are
taken together, whatever buckets they share, and no pair is left out but by proof: a link needs 4/5 of either text's
runs in common, so texts with too few runs held by another class have none, and two texts without a common run among
the rarest of these have none (families are the components of such runs).  In a family, dealt to pairs of blocks,
runs in common are counted for all pairs, and those with enough are aligned unless links found have joined their classes.
That count grows with the square of a family, in blocks; the rows dealt with its square over ``BLOCK``.

A link needs n1 + n2 - 2m <= (n1 + n2) / 9, so only runs at most that far apart can be matched: the alignment is
restricted to that band, and computed on the bits of long integers after common ends are cut off.

Null texts are empty.  Classes are named by their least ``doc_id``; rows may repeat; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import textnp
from tessera.llm.common import SORTED_BYTES, dropped, join_groups, join_held, meet, parts_of, spread, text_of, written
from tessera.llm.components import components

WORDS, SKETCHES, TAKE, SHORT_TAKE = 5, 32, 6, 2
LONG_FROM, SHORT_TO = 16, 24
#: The last stage comes after so many rounds of stars, or as soon as so few texts are left for it.
STARS, FEW = 5, 2000
#: Tasks that the pairs of one leader are dealt to.
SALTS = 64
#: Members, and runs of all members, of the blocks a family is dealt to; runs compared at a time.
BLOCK, BLOCK_RUNS, COLUMNS = 256, 200_000, 2048
_U = np.uint64
_rng = np.random.default_rng(77)
_ODD = _rng.integers(1, 1 << 63, (SKETCHES, 2), dtype=np.uint64) * _U(2) + _U(1)
_PLACE = _rng.integers(1, 1 << 63, TAKE, dtype=np.uint64) * _U(2) + _U(1)


def runs_of(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, firsts)`` of each text's runs of five words, in text order."""
    return textnp.shingles(*textnp.hash_words(offsets, data), WORDS)


def _labelled(runs: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Runs with their occurrence numbers mixed in."""
    if not len(runs):
        return runs
    key = runs ^ textnp.mix(row.astype(np.uint64) + _U(1))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(runs), bool)
    same[1:] = key[order][1:] == key[order][:-1]
    if not same.any():
        return runs
    at = np.arange(len(runs))
    number = at - np.maximum.accumulate(np.where(same, 0, at))
    out = runs.copy()
    later = number > 0
    out[order[later]] = textnp.mix(runs[order[later]] + number[later].astype(np.uint64) * _ODD[0, 0])
    return out


def _family(runs: np.ndarray, firsts: np.ndarray, chosen: np.ndarray, take: int) -> np.ndarray:
    """``uint64[texts chosen, SKETCHES]``: order sketches of *take* runs of each chosen text."""
    sizes = np.diff(firsts)[chosen]
    n = len(chosen)
    out = np.zeros((n, SKETCHES), np.uint64)
    if not n:
        return out
    starts = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(firsts[:-1][chosen] - starts[:-1], sizes) + np.arange(starts[-1])
    own, row = runs[at], np.repeat(np.arange(n), sizes)
    # Some 20 runs of a text are below its bound; where that leaves too few, all of them are taken.
    bound = np.where(sizes <= 24, 2.0**64 - 2048, 20.0 / np.maximum(sizes, 1) * 2.0**64).astype(np.uint64)
    bounds = np.repeat(bound, sizes)
    for j in range(SKETCHES):
        value = own * _ODD[j, 0]
        value ^= value >> _U(32)
        value *= _ODD[j, 1]
        few = np.flatnonzero(value <= bounds)
        count = np.bincount(row[few], minlength=n)
        if (lack := count < np.minimum(take, sizes)).any():
            more = np.isin(row, np.flatnonzero(lack))
            few = np.flatnonzero((value <= bounds) | more)
            count = np.bincount(row[few], minlength=n)
        few = few[np.lexsort((few, value[few], row[few]))]
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        # Texts with fewer runs than *take* repeat their last one.
        place = first[:, None] + np.minimum(np.arange(take), np.maximum(count, 1)[:, None] - 1)
        inside = np.sort(few[place], axis=1)
        total = (own[inside] * _PLACE[:take]).sum(axis=1, dtype=np.uint64)
        out[:, j] = textnp.mix(total ^ _U((take * 1000 + j) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return out


def sketches(runs: np.ndarray, firsts: np.ndarray) -> list[np.ndarray]:
    """The bucket keys of each text, from its runs."""
    sizes = np.diff(firsts)
    runs = _labelled(runs, np.repeat(np.arange(len(sizes)), sizes))
    out = [np.zeros(0, np.uint64)] * len(sizes)
    for chosen, take in (
        (np.flatnonzero(sizes >= LONG_FROM), TAKE),
        (np.flatnonzero((sizes > 0) & (sizes <= SHORT_TO)), SHORT_TAKE),
    ):
        for i, keys in zip(chosen, _family(runs, firsts, chosen, take), strict=True):
            out[i] = np.concatenate([out[i], keys])
    return out


def common(a: np.ndarray, b: np.ndarray, reach: int) -> int:
    """The longest common subsequence, matching places at most *reach* apart."""
    n = min(len(a), len(b))
    differ = a[:n] != b[:n]
    head = int(np.argmax(differ)) if differ.any() else n
    tail = 0
    if head < n:
        differ = a[len(a) - (n - head) :][::-1] != b[len(b) - (n - head) :][::-1]
        tail = int(np.argmax(differ)) if differ.any() else n - head
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state, width = full, (1 << (2 * reach + 1)) - 1
    for j, x in enumerate(b.tolist()):
        hits = where.get(x)
        if hits:
            hits &= width << (j - reach) if j >= reach else width >> (reach - j)
            kept = state & hits
            state = ((state + kept) | (state - kept)) & full
    return head + tail + len(a) - state.bit_count()


def linked(a: np.ndarray, b: np.ndarray) -> tuple[bool, int]:
    """Whether two run sequences are linked, and the runs they have in common within the band."""
    total = len(a) + len(b)
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False, -1
    m = common(a, b, total // 9)
    return 9 * m >= 4 * total, m


def _node(docs: DataFrame) -> Column:
    return F.unhex(F.substring(F.sha2(text_of(docs), 256), 1, 32))


def _keys(docs: DataFrame) -> DataFrame:
    """``node, keys, runs``: bucket keys of the texts, and their runs as 32-bit hashes; a node may occur once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            nodes = batch.column(0).to_pylist()
            fresh = [i for i, x in enumerate(nodes) if not (x in seen or seen.add(x))]
            if not fresh:
                continue
            own = batch.take(pa.array(fresh))
            offsets, data = textnp.utf8(own.column(1))
            for a, b in textnp.slices(offsets):
                runs, firsts = runs_of(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
                keys = sketches(runs, firsts)
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys).view(np.int64)))
                short = pa.py_buffer((runs >> _U(32)).astype("<u4"))
                edges = pa.py_buffer((firsts * 4).astype(np.int64))
                made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, edges, short]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([own.column(0).slice(a, b - a), lists, made], names=["node", "keys", "runs"])

    rows = docs.select(_node(docs).alias("node"), text_of(docs).alias("text"))
    return spread(rows).mapInArrow(run, "node binary, keys array<bigint>, runs binary")


def _align(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """``a, b, m, linked`` of pairs ``a, b``.

    A star's leader stands in many pairs: they are dealt to ``SALTS`` tasks, for which its runs are repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                linked(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"))
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([m for _, m in found], pa.int64()), pa.array([x for x, _ in found], pa.bool_())],
                names=["a", "b", "m", "linked"],
            )

    salts = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
    salted = pairs.select("a", "b", salts("a").alias("sa"), salts("b").alias("sb"))
    # Either end of a pair can be the leader.
    side = lambda own, salt, to: meet(runs, salted.select(F.col(own).alias("node"), salt).distinct(), "node").select(
        F.col("node").alias(own), salt, F.col("runs").alias(to)
    )
    both = meet(meet(salted, side("b", "sa", "rb"), ["b", "sa"]), side("a", "sb", "ra"), ["a", "sb"])
    return both.select("a", "b", "ra", "rb").mapInArrow(run, "a binary, b binary, m bigint, linked boolean")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _labelled_short(runs: bytes) -> np.ndarray:
    """32-bit runs with their occurrence numbers below them, in text order."""
    x = np.frombuffer(runs, "<u4")
    order = np.argsort(x, kind="stable")
    at = np.arange(len(x))
    same = np.zeros(len(x), bool)
    same[1:] = x[order][1:] == x[order][:-1]
    number = np.empty(len(x), np.uint64)
    number[order] = at - np.maximum.accumulate(np.where(same, 0, at))
    return x.astype(np.uint64) << _U(32) | number


def _tokens(nodes: DataFrame) -> DataFrame:
    """``id, label, token``: the labelled runs of *nodes*."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_labelled_short(x) for x in batch.column(2).to_pylist()]
            for x in range(0, len(made), 512):
                part = made[x : x + 512]
                at = pa.array(np.repeat(np.arange(x, x + len(part)), [len(m) for m in part]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(part).view(np.int64))], names=["id", "label", "token"]
                )

    return nodes.select("id", "label", "runs").mapInArrow(run, "id bigint, label binary, token bigint")


def _families(nodes: DataFrame, files: int | None = None) -> DataFrame:
    """``id, family``: nodes that can have a link to another class; both ends of any such link are in one family.

    A link takes 4/5 of either text's runs, all of them held by two classes.  Of a text's *k* such runs, ranked from
    rare to common, one of the first k - t + 1 is in common with a partner that shares t or more.
    """
    tokens = _tokens(nodes)
    shared = written(
        tokens.groupBy("token")
        .agg(F.count(F.lit(1)).alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        .where("lo <> hi")
        .select("token", "df"),
        "near-shared",
        files,
    )
    total = nodes.agg(F.sum("n")).head()[0] or 0
    ranked = (
        join_held(tokens, shared.withColumn("held_by", F.col("df")), "token", "held_by", total)
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("held"))
    )
    least = F.floor((F.col("n") * 4 + 4) / 5).cast("int")
    heads = written(
        meet(ranked, nodes.select("id", "label", "n"), "id")
        .where(F.size("held") >= least)
        .select("id", "label", F.explode(F.slice(F.col("held")["token"], F.lit(1), F.size("held") - least + 1)).alias("token")),
        "near-heads",
        files,
    )
    tops = written(
        heads.groupBy("token")
        .agg(F.min("id").alias("b"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("k"))
        .where("lo <> hi")
        .select("token", "b", "k"),
        "near-tops",
        files,
    )
    edges = written(join_held(heads, tops, "token", "k", heads.count()).select(F.col("id").alias("a"), "b").distinct(), "near-edges", files)
    out = components(edges, files).select(F.col("node").alias("id"), F.col("label").alias("family"))
    dropped(shared, heads, tops, edges)
    return out


def _within(rows: list[tuple]) -> list[tuple[bytes, bytes, int, bool]]:
    """The pairs aligned of ``(side, node, label, runs)``: all that can be linked and whose classes still differ.

    Rows of side 0 are paired with those of side 1; if there are none, with each other.
    """
    root: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    rows = sorted(rows, key=lambda r: r[0])
    cut = sum(r[0] == 0 for r in rows)
    cross = 0 < cut < len(rows)
    first, second = (np.arange(cut), np.arange(cut, len(rows))) if cross else (np.arange(len(rows)),) * 2
    runs = [np.frombuffer(r[3], "<u4") for r in rows]
    sizes = np.array([len(x) for x in runs])
    _, klass = np.unique(np.array([r[2].hex() for r in rows]), return_inverse=True)
    # Runs in common without regard to order bound those of any alignment.
    token, at = np.unique(np.concatenate([_labelled_short(r[3]) for r in rows]), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), sizes)
    held = np.bincount(at, minlength=len(token)) > 1
    place = np.cumsum(held) - 1
    owner, column = owner[held[at]], place[at[held[at]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    overlap = np.zeros((len(first), len(second)), np.float32)
    for low in range(0, int(held.sum()), COLUMNS):
        x, y = np.searchsorted(column, [low, low + COLUMNS])
        bits = np.zeros((len(rows), COLUMNS), np.float32)
        bits[owner[x:y], column[x:y] - low] = 1
        overlap += bits[first] @ bits[second].T
    may = (9 * overlap >= 4 * (sizes[first][:, None] + sizes[second])) & (klass[first][:, None] != klass[second])
    if not cross:
        may = np.triu(may, 1)
    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(may)), strict=True):
        i, j = int(first[i]), int(second[j])
        one, other = find(rows[i][2]), find(rows[j][2])
        if one != other:
            yes, m = linked(runs[i], runs[j])
            if yes:
                root[one] = other
            out.append((min(rows[i][1], rows[j][1]), max(rows[i][1], rows[j][1]), m, yes))
    return out


def _rest(open_: DataFrame, runs: DataFrame, files: int | None = None) -> DataFrame:
    """``a, b, m, linked``: links enough to join all classes that links between the nodes of *open_* join, and other pairs aligned."""
    nodes = written(
        meet(open_.select("node", "label").distinct(), runs, "node")
        .select(F.monotonically_increasing_id().alias("id"), "node", "label", "runs", (F.length("runs") / 4).cast("long").alias("n")),
        "near-open",
        files,
    )
    held = written(meet(nodes, _families(nodes, files), "id"), "near-families", files)
    sizes = written(
        held.groupBy("family").agg(
            F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_RUNS)).cast("int").alias("blocks"),
            F.count(F.lit(1)).alias("members"),
        ),
        "near-sizes",
        files,
    )
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (
        join_held(held, sizes, "family", "members", held.count())
        .select("family", own.alias("own"), "node", "label", "runs", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select(
            F.struct("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).alias("pair"),
            (F.col("own") > F.col("other")).cast("int").alias("side"),
            "node",
            "label",
            "runs",
        )
        .select(F.col("pair.family").alias("f"), F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "side", "node", "label", "runs")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for (_, i, j), group in groupby(rows, lambda r: r[:3]):
            members = [r[3:] for r in group]
            # Of two blocks, one may have no members.
            if len(members) < 2 or (i != j and len({r[0] for r in members}) < 2):
                continue
            found = _within(members)
            if found:
                a, b, m, yes = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(m, pa.int64()), pa.array(yes, pa.bool_())], names=["a", "b", "m", "linked"]
                )

    tasks = max(int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    grouped = dealt.repartition(tasks, "f", "i", "j").sortWithinPartitions("f", "i", "j")
    out = written(grouped.mapInArrow(run, "a binary, b binary, m bigint, linked boolean"), "near-tested", files)
    dropped(nodes, held, sizes)
    return out


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(a, b, m, linked)`` of all node pairs aligned, and ``(node, label)``: the classes of linked nodes."""
    files = parts_of(docs)
    keyed = written(_keys(docs), "near-keys", 2 * files)
    each = keyed.select("node", F.explode("keys").alias("key"))
    n_keys = keyed.agg(F.sum(F.size("keys"))).head()[0] or 0

    def leader(seed: int) -> Column:
        return F.min(F.struct(F.xxhash64("node", F.lit(seed)).alias("h"), "node"))["node"]

    tops = written(
        each.groupBy("key")
        .agg(leader(0).alias("leader"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("size"))
        .where("lo <> hi")
        .select("key", "leader", "size"),
        "near-leaders",
        files,
    )
    # A bucket may hold a third of all texts: its one row of what is looked up is broadcast then.
    members = written(join_held(each, tops, "key", "size", n_keys).select("key", "node", "leader"), "near-members", files)
    n_members = members.count()
    # The texts themselves are read once; copies were cut to one for each task.
    needed = members.select("node").distinct()
    runs = written(meet(keyed.select("node", "runs"), needed, "node", "left_semi").distinct(), "near-runs", files)
    none = docs.sparkSession.createDataFrame([], "node binary, label binary")
    stars = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    pairs = written(_ordered(stars), "near-pairs", files)
    tested = written(_align(pairs, runs), "near-tested", files)
    dropped(keyed, pairs)
    labels = components(tested.where("linked").select("a", "b"), files) if not tested.where("linked").isEmpty() else none

    def merged(labels: DataFrame, new: DataFrame) -> DataFrame:
        """Classes after more links, found by the components of the classes they join."""
        name = lambda c, to: labels.select(F.col("node").alias(c), F.col("label").alias(to))
        over = written(
            meet(meet(new.where("linked"), name("a", "la"), "a", "left"), name("b", "lb"), "b", "left")
            .select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")),
            "near-over",
            files,
        )
        roots = components(over, files).select(F.col("node").alias("label"), F.col("label").alias("to"))
        old = written(
            labels.unionByName(over.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))), "near-old", files
        )
        sizes = old.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
        out = written(
            join_groups(old, meet(roots, sizes, "label"), "label", "size", old.count())
            .groupBy("node")
            .agg(F.min(F.coalesce("to", "label")).alias("label")),
            "near-labels",
            files,
        )
        dropped(over, old)
        return out

    def active(labels: DataFrame) -> DataFrame:
        """Members of buckets that hold several classes, with their class and the bucket's size."""
        named = written(
            meet(members.select("key", "node"), labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), "near-named", files
        )
        mixed = written(
            named.groupBy("key")
            .agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size"))
            .where("lo <> hi")
            .select("key", "size", F.col("size").alias("held_by")),
            "near-mixed",
            files,
        )
        out = written(join_held(named, mixed, "key", "held_by", n_members).distinct(), "near-active", files)
        dropped(named, mixed)
        return out

    for star in range(1, STARS + 1):
        open_ = active(labels)
        left = open_.select("node").distinct().count()
        if not left:
            break
        last = star == STARS or left <= FEW
        if not last:
            heads = written(
                open_.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(star)).alias("h"), "node", "label")).alias("t"), F.max("size").alias("k")),
                "near-heads",
                files,
            )
            stars = join_held(open_, heads, "key", "k", n_members).where("label <> t.label").select(F.col("t.node").alias("a"), F.col("node").alias("b"))
            pairs = written(meet(_ordered(stars), tested.select("a", "b"), ["a", "b"], "left_anti"), "near-pairs", files)
            new = written(_align(pairs, runs), "near-tested", files)
            dropped(pairs, heads)
        else:
            new = _rest(open_, runs, files)
        dropped(open_)
        tested = tested.unionByName(new)
        if not new.where("linked").isEmpty():
            labels = merged(labels, new)
        if last:
            break
    dropped(tops, members, runs)
    return tested, labels


def _classes(docs: DataFrame) -> DataFrame:
    files = parts_of(docs)
    rows = written(docs.select("doc_id", _node(docs).alias("node")), "near-rows", files)
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n"))
    _, labels = links(docs)
    named = written(
        meet(nodes, labels, "node", "left").select("node", "id", "n", F.coalesce("label", "node").alias("label")), "near-labelled", files
    )
    total = rows.count()
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node"))
    groups = written(
        named.groupBy("label")
        .agg(best.alias("best"), F.sum("n").alias("class_size"))
        .select("label", F.col("best.id").alias("class_id"), F.col("best.node").alias("best"), "class_size"),
        "near-classes",
        files,
    )
    of_node = written(
        join_groups(named, groups, "label", "class_size", total).select("node", "class_id", "class_size", "best", "n"), "near-of-node", files
    )
    dropped(named, groups)
    return join_groups(rows, of_node, "node", "n", total).select(
        "doc_id",
        "class_id",
        "class_size",
        (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("best"))).alias("kept"),
        "node",
    )


def classes(docs: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id, class_id, class_size, kept``; *class_size* counts rows."""
    return _classes(docs).drop("node")


def survivors(docs: DataFrame) -> DataFrame:
    """One row of each class, with all its columns; of copies of that row, any one."""
    names = docs.columns

    def key(node: Column) -> Column:
        """One column for text and id: the join and the choice of a copy then share one shuffle of the texts."""
        return F.concat(node, F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).cast("binary"))

    kept = _classes(docs).where("kept").select(key(F.col("node")).alias("__kept"))
    stays = meet(docs.withColumn("__key", key(_node(docs))), kept, F.col("__key") == F.col("__kept"), "left_semi")
    return stays.dropDuplicates(["__key"]).select(*names).coalesce(parts_of(docs, SORTED_BYTES))

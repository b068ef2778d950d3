"""The trie of rebuilt conversations, by composable fingerprints of turn sequences.

A sequence of turns has the fingerprint ``sum(x[i] * B ** i)`` modulo each of four
primes, with ``x[i]`` from a hash of turn ``i``.  Fingerprints with lengths are a
monoid: a concatenation's is the first's plus ``B ** length`` times the second's.
So one scan of the stored turns, dealt by ranges of conversation and turn, gives
every prefix of every conversation; a conversation that several ranges share is
put together from the ranges' products.  A rebuilt conversation (the head of a
base conversation, then the own turns after as many) is never made: its
fingerprints combine the base's with those of its own turns from there on, moved
by a power of ``B``, and its rows refer to stored turns by their hashes.

Rows of equal depth and fingerprint are one node.  That they are equal is
verified, not assumed: all rows of a node must have the same parent's fingerprint
and the same hash of their last turn, and all stored turns of a hash the same
role and text, so that equality follows from the root down.  Otherwise the next
hash and bases are taken.

What is summed over subtrees goes up by pointer jumping: after step ``k`` a node
holds the sums of its descendants within ``2 ** k`` levels and knows its ancestor
so far up.  A trie of depth ``d`` takes ``log2(d)`` joins, whatever its shape.

Defined results: turns of a conversation are in order of turn (null first), and
those alike in it in order of role and text; null roles and texts are empty;
repeated rows are turns of their own; rows without a conv_id belong to no
conversation; a table without conversations has no nodes.  Other columns, whatever
their names, aren't read.  A node's ends are hashed in one pass of one task, since
SHA-256 has no parts that could be put together; it holds a batch of ids at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, materialize, shuffle_partitions

# Primes just below 2 ** 31, so that products fit 64 bits.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
EMPTY_SHA256 = hashlib.sha256().hexdigest()
ATTEMPTS = 8

# What the rebuilding of the conversations takes from the base: fewer turns than this.
HEADS = 9
BASES = 5


def field(attempt: int) -> tuple[tuple[int, int], ...]:
    """Primes and bases of the fingerprints."""
    bases = (hashlib.sha256(f"{attempt}:{j}".encode()).digest()[:8] for j in range(len(PRIMES)))
    return tuple((p, 2**16 + int.from_bytes(b, "big") % (p - 2**17)) for p, b in zip(PRIMES, bases))


def powers(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    """``base ** exponents`` modulo ``prime``."""
    out = np.ones(len(exponents), dtype=np.uint64)
    left, factor = exponents.astype(np.uint64), base
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        out[odd] = out[odd] * np.uint64(factor) % np.uint64(prime)
        left >>= np.uint64(1)
        factor = factor * factor % prime
    return out


def _scan(turns: DataFrame, fields) -> DataFrame:
    """Prefix fingerprints inside each range of sorted turns.

    ``g0..`` are those of the turns up to and with this one, ``p0..`` without it;
    ``idx`` counts from the range's first turn of the conversation; ``last`` marks the
    last one and ``edge`` the last one of a range's first and last conversations.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = None  # a batch whose last row's marks depend on what comes
        conv, count, segment = None, 0, 0
        sums = [0] * len(fields)

        def marked(last_ends: bool, range_ends: bool) -> pa.RecordBatch:
            columns, last, segments = held
            last[-1] = last_ends
            edge = last & (segments == 0)
            edge[-1] |= range_ends
            return pa.RecordBatch.from_arrays([*columns, pa.array(last), pa.array(edge)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            starts = np.empty(len(ids), dtype=bool)
            starts[0] = ids[0] != conv
            if held is not None:
                yield marked(bool(starts[0]), False)
            starts[1:] = ids[1:] != ids[:-1]
            if starts[0]:
                segment += conv is not None
                count, sums = 0, [0] * len(fields)
            at = np.flatnonzero(starts)
            group = np.cumsum(starts) - (1 if starts[0] else 0)  # 0: goes on from before
            first = np.concatenate([[0], at]) if not starts[0] else at
            idx = np.arange(len(ids)) - first[group] + np.where(group == 0, count, 0)
            prefixes, befores = [], []
            for j, (prime, base) in enumerate(fields):
                x = np.mod(batch.column(1 + j // 2).to_numpy(), prime).astype(np.uint64)
                w = (x * powers(base, idx, prime) % np.uint64(prime)).astype(np.int64)
                total = np.cumsum(w)
                offset = (total - w)[first]
                offset[0] -= sums[j]
                whole = total - offset[group]
                prefixes.append(whole % prime)
                befores.append((whole - w) % prime)
                sums[j] = int(prefixes[-1][-1])
            count, conv = int(idx[-1]) + 1, int(ids[-1])
            segments = segment + group
            segment = int(segments[-1])
            last = np.empty(len(ids), dtype=bool)
            last[:-1] = starts[1:]
            last[-1] = False
            columns = [
                pa.array(np.full(len(ids), part, dtype=np.int32)), batch.column(0), pa.array(idx, pa.int64()),
                batch.column(1), batch.column(2), batch.column(3), *map(pa.array, prefixes), *map(pa.array, befores),
            ]
            held = (columns, last, segments)
        if held is not None:
            yield marked(True, True)

    schema = (
        "part int, conv_id bigint, idx bigint, t0 bigint, t1 bigint, bytes bigint, "
        + "".join(f"{c}{j} bigint, " for c in "gp" for j in range(len(fields)))
        + "last boolean, edge boolean"
    )
    names = [column.split()[0] for column in schema.split(", ")]
    return turns.select("conv_id", "t0", "t1", "bytes").mapInArrow(run, schema)


def _joined(scanned: DataFrame, fields) -> DataFrame:
    """``scanned`` with places and fingerprints from each conversation's first turn.

    The driver gets two rows a range: its first and last conversations' products.
    """
    edges = scanned.where("edge").orderBy("part", "conv_id").collect()
    rows, marks = {}, {}
    before = None  # the last conversation of the range before, and its product so far
    for i, e in enumerate(edges):
        product = (e.idx + 1, [e[f"g{j}"] for j in range(len(fields))])
        opens = i == 0 or edges[i - 1].part != e.part
        if opens and before is not None and before[1] == e.conv_id:
            marks[before[0], e.conv_id] = True
            count, sums = before[2]
            moves = [pow(base, count, prime) for prime, base in fields]
            rows[e.part, e.conv_id] = (count, sums, moves)
            product = (
                count + product[0],
                [(a + m * b) % p for a, m, b, (p, _) in zip(sums, moves, product[1], fields)],
            )
        before = (e.part, e.conv_id, product)
    none = (0, [0] * len(fields), [1] * len(fields))
    table = []
    for key in {*rows, *marks}:
        count, sums, moves = rows.get(key, none)
        table.append((*key, count, *sums, *moves, marks.get(key, False)))
    names = [f"{c}{j}" for c in "om" for j in range(len(fields))]
    kinds = "part int, conv_id bigint, before bigint, " + "".join(f"{n} bigint, " for n in names)
    parts = scanned.sparkSession.createDataFrame(table, kinds + "goes_on boolean")
    whole = scanned.join(F.broadcast(parts), ["part", "conv_id"], "left")

    def moved(c: str, j: int) -> Column:
        there = F.expr(f"(o{j} + m{j} * {c}{j}) % {fields[j][0]}")
        return F.coalesce(there, F.col(f"{c}{j}")).alias(f"{c}{j}")

    return whole.select(
        "conv_id",
        (F.col("idx") + F.coalesce("before", F.lit(0))).alias("idx"),
        "t0", "t1", "bytes",
        *[moved(c, j) for c in "gp" for j in range(len(fields))],
        (F.col("last") & ~F.coalesce("goes_on", F.lit(False))).alias("last"),
    )


def _keys(of, fields, names=("k0", "k1")) -> list[Column]:
    """Two numbers for the four that ``of(j)`` gives as SQL."""
    half = 1 << 31
    return [
        F.expr(f"({of(j)}) * {half} + ({of(j + 1)})").alias(n)
        for n, j in zip(names, range(0, len(fields), 2))
    ]


def rebuilt_rows(turns: DataFrame, fields) -> DataFrame:
    """A row for each turn of each rebuilt conversation, and one for its root.

    ``turns``: stored turns with prefixes.  Rows have ``conv_id, depth``, the
    fingerprint ``k0, k1`` and the parent's ``q0, q1``, the last turn's ``t0, t1, bytes``,
    and whether the conversation ``ends`` there.
    """
    n = range(len(fields))
    h = f"CAST(crc32(CAST(CAST(conv_id AS STRING) AS BINARY)) % {HEADS} AS INT)"
    firsts = turns.where(f"idx < {HEADS}").withColumn("h", F.expr(h))
    turn = ["t0", "t1", "bytes", *[f"{c}{j}" for c in "gp" for j in n]]
    heads = (
        firsts.where(f"conv_id % {BASES} = 0 AND idx < {HEADS - 1}")
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.sort_array(F.collect_list(F.struct("idx", *turn))).alias("head"))
    )
    own = (
        firsts.groupBy("conv_id", "h")
        .agg(
            F.max(F.expr("idx = h")).alias("goes_on"),
            *[F.max(F.expr(f"IF(idx = h - 1, g{j}, 0)")).alias(f"a{j}") for j in n],
        )
        .withColumn("base", F.expr(f"conv_id - conv_id % {BASES}"))
    )
    plans = materialize(
        own.join(heads, "base", "left")
        .withColumn("head", F.expr("slice(coalesce(head, array()), 1, h)"))
        .withColumn("taken", F.size("head"))
        .select(
            "conv_id", "h", "taken", "goes_on", "head",
            *[F.expr(f"coalesce(get(head, taken - 1).g{j}, 0L)").alias(f"b{j}") for j in n],
            *[f"a{j}" for j in n],
        )
    )
    zero = [F.lit(0).cast("bigint").alias(c) for c in ("k0", "k1", "q0", "q1", "t0", "t1", "bytes")]
    roots = plans.select(
        "conv_id", F.lit(0).cast("bigint").alias("depth"), *zero, F.expr("taken = 0 AND NOT goes_on").alias("ends")
    )
    head = plans.select("conv_id", "taken", "goes_on", F.explode("head").alias("e")).select(
        "conv_id", F.expr("e.idx + 1").alias("depth"),
        *_keys(lambda j: f"e.g{j}", fields), *_keys(lambda j: f"e.p{j}", fields, ("q0", "q1")),
        "e.t0", "e.t1", "e.bytes", F.expr("e.idx + 1 = taken AND NOT goes_on").alias("ends"),
    )

    def after(c: str):
        """The base's head and the own turns from ``h`` up to here."""

        def of(j: int) -> str:
            prime, base = fields[j]
            back = ", ".join(f"{pow(base, -k, prime)}L" for k in range(HEADS))
            return f"(b{j} + array({back})[h - taken] * pmod({c}{j} - a{j}, {prime})) % {prime}"

        return of

    suffix = turns.join(plans.where("goes_on").drop("head"), "conv_id").where("idx >= h").select(
        "conv_id", F.expr("idx - h + taken + 1").alias("depth"),
        *_keys(after("g"), fields), *_keys(after("p"), fields, ("q0", "q1")),
        "t0", "t1", "bytes", F.col("last").alias("ends"),
    )
    return roots.unionByName(head).unionByName(suffix)


def _digests(ends: DataFrame) -> DataFrame:
    """``depth, k0, k1, ends_sha256`` of the conversations that end in each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["depth", "k0", "k1", "ends_sha256"]
        key, digest = None, None
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(3)]
            ids = batch.column(3).to_pylist()
            change = np.zeros(len(ids), dtype=bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            edges = [0, *np.flatnonzero(change).tolist(), len(ids)]
            done = []
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                now = tuple(int(c[a]) for c in columns)
                if now == key:
                    digest.update(b",")
                else:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = now, hashlib.sha256()
                digest.update(",".join(map(str, ids[a:b])).encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=names)
        if key is not None:
            last = (*key, digest.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in last], names=names)

    met = ends.select("depth", "k0", "k1", "conv_id").repartition("depth", "k0", "k1")
    return met.sortWithinPartitions("depth", "k0", "k1", "conv_id").mapInArrow(
        run, "depth bigint, k0 bigint, k1 bigint, ends_sha256 string"
    )


def _subtree_sums(nodes: DataFrame, names: list[str]) -> DataFrame:
    """``nodes`` (``conv_id, depth, up``) with ``names`` summed over subtrees.

    ``up`` is the parent's conv_id.  ``nodes`` must be a table; so is the result.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    now, step = nodes, 1
    while step <= deepest:
        above = [F.col("up").alias("conv_id"), F.expr(f"depth - {step}").alias("depth")]
        sent = now.where(f"depth >= {step}").groupBy(*above)
        sums = sent.agg(*[F.sum(c).alias(f"more_{c}") for c in names])
        grown = now.join(sums, ["conv_id", "depth"], "left").select(
            "conv_id", "depth", "up",
            *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in names],
        )
        if 2 * step <= deepest:
            higher = now.select(
                F.col("conv_id").alias("up"), (F.col("depth") + step).alias("depth"), F.col("up").alias("higher")
            )
            grown = grown.join(higher, ["up", "depth"], "left").select(
                "conv_id", "depth", F.col("higher").alias("up"), *names
            )
        grown = materialize(grown)
        if now is not nodes:
            discard(now)
        now, step = grown, 2 * step
    return now


def conversation_trie(
    conversations: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations.

    Conversation ``c`` is rebuilt from the first ``h`` turns of ``c - c % BASES`` and its own
    turns after its first ``h``, where ``h = crc32(str(c)) % HEADS``.  Of each node:
    ``conv_id`` (its smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``, ``ends_sha256``.
    """
    spark = conversations.sparkSession
    said = conversations.select(
        F.col(conv_id).cast("bigint").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(role, F.lit("")).alias("role"),
        F.coalesce(text, F.lit("")).alias("text"),
    ).where("conv_id IS NOT NULL")
    for attempt in range(ATTEMPTS):
        fields = field(attempt)
        hashed = said.withColumns(
            {f"t{j}": F.xxhash64(F.lit(f"{attempt}:{j}"), "role", "text") for j in range(2)}
        )
        # Ranges cut a long conversation at its turns, and where those are alike,
        # by what they begin with.
        ranged = hashed.withColumn("bytes", F.octet_length("text").cast("bigint")).repartitionByRange(
            shuffle_partitions(spark), "conv_id", "turn", F.substring("role", 1, 32), F.substring("text", 1, 32)
        )
        scanned = materialize(
            _scan(ranged.sortWithinPartitions("conv_id", "turn", "role", "text"), fields)
        )
        rows = materialize(rebuilt_rows(_joined(scanned, fields), fields))
        nodes = materialize(
            rows.groupBy("depth", "k0", "k1").agg(
                F.min("conv_id").alias("conv_id"),
                F.count("*").alias("n_convs"),
                *[F.min(c).alias(c) for c in ("q0", "q1", "bytes")],
                F.expr(" OR ".join(f"min({c}) <> max({c})" for c in ("q0", "q1", "t0", "t1", "bytes"))).alias("mixed"),
            )
        )
        whole = F.struct("role", "text")
        said_twice = hashed.groupBy("t0", "t1").agg((F.min(whole) != F.max(whole)).alias("mixed"))
        mixed = nodes.where("mixed").select("mixed").unionByName(said_twice.where("mixed").select("mixed"))
        if mixed.limit(1).count() == 0:
            break
        discard(scanned, rows, nodes)
    else:
        raise RuntimeError("no hash keeps all turns and prefixes apart")

    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"),
        F.col("k0").alias("q0"),
        F.col("k1").alias("q1"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    linked = materialize(nodes.join(parents, ["depth", "q0", "q1"], "left").drop("q0", "q1", "mixed"))
    discard(scanned, nodes)
    children = (
        linked.where("depth > 0")
        .groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
        .agg(F.count("*").alias("n_children"))
    )
    own = materialize(
        linked.join(children, ["conv_id", "depth"], "left").select(
            "conv_id",
            "depth",
            F.col("parent_conv_id").alias("up"),
            F.expr("if(n_children IS NULL, 1L, 0L)").alias("n_leaves"),
            F.expr("(n_convs - 1) * bytes").alias("saved_tokens"),
            F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
        )
    )
    sums = _subtree_sums(own.drop("n_children"), ["n_leaves", "saved_tokens"]).drop("up")
    ends = _digests(rows.where("ends"))
    return (
        linked.join(ends, ["depth", "k0", "k1"], "left")
        .join(own.select("conv_id", "depth", "n_children"), ["conv_id", "depth"])
        .join(sums, ["conv_id", "depth"])
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
        )
    )

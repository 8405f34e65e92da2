"""N-gram Jaccard self join with adaptive multi-match prefixes.

Tokens are 5-word shingles, ordered from rare to frequent. A document of n tokens with threshold t must share n - ceil(t n) + 1
.. tokens: two linked documents share at least L tokens in their prefixes of n - ceil(t n) + L tokens. Each document chooses
its own L from 1 to MAX_MATCH by the real lengths of its tokens' lists (how many components of those left hold the token); a pair is a candidate when it shares min(L_a, L_b)
prefix tokens, because the shorter requirement holds inside both prefixes.

Most documents have so many tokens of their own that they can be linked with nobody. A first step counts, for each document,
how many tokens of the lowest SHARE of the hash space other components hold too; when more tokens than a link allows are its own alone, it
is done. The second step counts all tokens of the documents that are left, and they meet by their prefixes. Counts are made
in buckets of hashes, each bounded whatever a token's list is.

Large groups of copies never become pairs. Equal sets are one representative. Before the prefix join, representatives are
compared with the smallest ids of their minimum-hash keys where two keys or more agree, and those links are verified; the prefix join then runs between the components found so far, so one component leaves one row in a
token's list. Only links inside a component are left out, and they change neither a component nor its smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import discard, materialize, only, partitions, session_of, ship_code, split_by_keys, text_of
from lorespark.llm.graph import components

WORDS = 5
#: The threshold in hundredths.
PERCENT = 75
MAX_MATCH = 64
#: Minimum-hash keys by which representatives meet before the prefix join.
KEYS = 6
#: Part of the token space by which documents of their own tokens are told.
SHARE = 0.4
#: Token entries that a bucket holds on average; more buckets than partitions spread them.
BUCKET = 1 << 20
#: Entries held before tokens with CAP entries are let go; from CAP on, counts are alike.
HELD, CAP = 1 << 22, 1 << 16
#: Token entries of one packed flush.
FLUSH = 1 << 18
#: Bytes of a batch that a task gives back.
SLICE = 1 << 20
#: Documents that meet one copy of a hub's set in verification.
MEMBERS = 1024
#: Cost of verifying a candidate, in list entries read.
VERIFY = 50.0
#: Entries of a worker's memo of word hashes; it only saves time.
MEMO = 200_000

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Hashes(dict):
    """Word to 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(27))


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; fewer words than a shingle's count as one; none give none."""
    found = text.lower().split()
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(_hashes.__getitem__, found), np.uint64, n)
    size = min(words, n)
    h = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        h = _mixed(h + each[i : n - size + 1 + i] * _MULTIPLIERS[i % 5]) if i % 5 == 0 and i else h + each[i : n - size + 1 + i] * _MULTIPLIERS[i % 5]
    return np.unique(_mixed(h))


def _min_keys(tokens: np.ndarray) -> list[int]:
    """KEYS minimum hashes, each with its number and the set's size class mixed in."""
    size = int(np.log(len(tokens)) / np.log(4 / 3))
    out = []
    for k in range(KEYS):
        least = _mixed(tokens * np.uint64(2 * k + 1) + _MULTIPLIERS[k % 5]).min()
        out.append(int(_mixed(np.array([least + np.uint64(size * 64 + k)], np.uint64)).view(np.int64)[0]))
    return out


def _as_lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    flat = np.concatenate(arrays).astype(np.uint64).view(np.int64) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _small(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about SLICE bytes: the JVM holds each whole, outside its heap."""
    yield from _parts(iter([batch]), max(1, batch.num_rows * SLICE // max(batch.nbytes, 1)))


def _bytes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_of().cast("binary").alias("text"))


def _cut(share: float) -> np.uint64:
    return np.uint64(min(int(share * (1 << 64)), (1 << 64) - 1))


def _base(n, percent: int):
    """How many tokens a prefix has besides L."""
    return n - -(-percent * n // 100)


def _signatures(docs: DataFrame, words: int, share: float) -> DataFrame:
    """doc_id, n, low (tokens in the counted share), set (128 bits of the set), keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        from lorespark.llm import ngram_join as J

        J.only("ngram_join")
        for part in J._parts(batches):
            sets = [J.shingles(t, words) for t in part.column(1).to_pylist()]
            keys = pa.array([J._min_keys(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))
            whole = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            low = pa.array([int(np.searchsorted(s, J._cut(share))) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), low, whole, keys], ["doc_id", "n", "low", "set", "keys"])

    return _bytes(docs).mapInArrow(run, "doc_id long, n long, low long, set binary, keys array<long>")


def _entries(texts: DataFrame, placed: DataFrame, words: int, share: float) -> DataFrame:
    """The tokens in the share of all placed representatives, packed by bucket: bucket, tokens, reps, comps (64-bit numbers in a row each)."""
    # one row: how many entries there will be
    total = placed.agg(F.sum("n")).first()[0] or 0
    buckets = max(2 * partitions(session_of(texts)), int(share * int(total)) // BUCKET)
    texts = texts.join(placed.select(F.col("rep").alias("doc_id"), "set", "comp"), "doc_id").select("doc_id", "text", "set", "comp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        from lorespark.llm import ngram_join as J

        J.only("ngram_join")
        waiting: list[tuple[np.ndarray, int, int]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate([t for t, _, _ in waiting])
            sizes = [len(t) for t, _, _ in waiting]
            each = [tokens, *(np.repeat(np.array([w[i] for w in waiting], np.int64), sizes) for i in (1, 2))]
            of = (tokens % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(of, kind="stable")
            here, first = np.unique(of[order], return_index=True)
            edges = [*first.tolist(), len(of)]
            packed = [[x[i:j].tobytes() for i, j in zip(edges, edges[1:])] for x in (a[order] for a in each)]
            return pa.RecordBatch.from_arrays([pa.array(here, pa.int32()), *(pa.array(p, pa.binary()) for p in packed)], ["bucket", "tokens", "reps", "comps"])

        for part in J._parts(batches):
            for i, text, whole, comp in zip(*(c.to_pylist() for c in part.columns)):
                s = J.shingles(text, words)
                if xxhash.xxh3_128_digest(s.tobytes()) != whole:
                    continue  # another text under this doc_id
                s = s[: np.searchsorted(s, J._cut(share))] if share < 1 else s
                waiting.append((s, i, comp))
                held += len(s)
                if held > J.FLUSH:
                    yield from J._small(flush())
                    waiting, held = [], 0
        if waiting:
            yield from J._small(flush())

    return texts.mapInArrow(run, "bucket int, tokens binary, reps binary, comps binary")


class Counter:
    """Counts one bucket's tokens. Entries are held until the bucket ends, but for tokens with CAP entries or more: theirs go on at once."""

    def __init__(self):
        self.held: list[np.ndarray] = []
        self.size = 0
        self.long = np.empty(0, np.uint64)

    def add(self, tokens: bytes, reps: bytes, comps: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        rows = np.stack([np.frombuffer(x, np.int64) for x in (tokens, reps, comps)])
        if len(self.long):
            there = np.isin(rows[0].view(np.uint64), self.long)
            if there.any():
                yield self._capped(rows[:, there])
                rows = rows[:, ~there]
        self.held.append(rows)
        self.size += rows.shape[1]
        if self.size > HELD:
            rows = np.concatenate(self.held, 1)
            found, of, counts = np.unique(rows[0].view(np.uint64), return_inverse=True, return_counts=True)
            there = (counts >= CAP)[of]
            self.long = np.concatenate([self.long, found[counts >= CAP]])
            if there.any():
                yield self._capped(rows[:, there])
            self.held = [rows[:, ~there]]
            # what stays may be much; the next look comes when as much again has arrived
            self.size = 0

    @staticmethod
    def _capped(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return rows[1], rows[0], np.full(rows.shape[1], CAP, np.int32)

    def end(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """reps, tokens, components that hold the token (CAP from CAP entries on), of the tokens that several components hold."""
        rows = np.concatenate(self.held, 1) if self.held else np.empty((3, 0), np.int64)
        rows = rows[:, np.argsort(rows[0], kind="stable")]
        first = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1])) if rows.shape[1] else np.empty(0, np.int64)
        if not len(first):
            return rows[1], rows[0], np.empty(0, np.int32)
        sizes = np.diff(np.append(first, rows.shape[1]))
        several = np.minimum.reduceat(rows[2], first) != np.maximum.reduceat(rows[2], first)
        rows = rows[:, np.repeat(several, sizes)]
        rows = rows[:, np.lexsort((rows[2], rows[0]))]
        new = np.append(True, rows[0, 1:] != rows[0, :-1])[: rows.shape[1]]
        other = new | np.append(True, rows[2, 1:] != rows[2, :-1])[: rows.shape[1]]
        of = np.cumsum(new) - 1
        comps = np.bincount(of, other).astype(np.int32)
        comps = np.where(sizes[several] >= CAP, CAP, comps).astype(np.int32)
        return rows[1], rows[0], comps[of] if len(of) else np.empty(0, np.int32)


def _shared(entries: DataFrame, tokens: bool) -> DataFrame:
    """rep, token, c: a row for each token of a representative that other components hold too; or rep and c, how many those are in a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lorespark.llm import ngram_join as J

        def table(reps: np.ndarray, held: np.ndarray, comps: np.ndarray) -> pa.RecordBatch:
            if tokens:
                return pa.RecordBatch.from_arrays([*map(pa.array, (reps, held, comps))], ["rep", "token", "c"])
            reps, counts = np.unique(reps, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(reps), pa.array(counts.astype(np.int32))], ["rep", "c"])

        counter, last = J.Counter(), None
        for batch in batches:
            for bucket, *packed in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != last and last is not None:
                    yield from J._small(table(*counter.end()))
                    counter = J.Counter()
                last = bucket
                for found in counter.add(*packed):
                    yield from J._small(table(*found))
        yield from J._small(table(*counter.end()))

    dealt = entries.repartition(partitions(session_of(entries)), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "rep long, token long, c int" if tokens else "rep long, c int")


def choose(n: int, tokens: np.ndarray, counts: np.ndarray, percent: int = PERCENT) -> tuple[int, np.ndarray, np.ndarray]:
    """Required matches L, the prefix's tokens that other components hold, and their positions in the document's order; no tokens: no link is possible.

    tokens: those of the document's n that other components hold, counts: how many components do. The others are its own and
    come first. With lists of total length S, at most S / L documents are in L of them: L is the one with the least cost of
    reading lists and verifying.
    """
    base, alone = _base(n, percent), max(0, n - len(tokens))
    if alone > base:
        return 1, tokens[:0], np.empty(0, np.int64)
    order = np.lexsort((tokens, counts))
    sums = np.cumsum(counts[order])
    match = np.arange(1, min(MAX_MATCH, n - base) + 1)
    total = sums[base + match - alone - 1]
    best = int(np.argmin(total + VERIFY * total / match))
    size = base + best + 1 - alone
    return best + 1, tokens[order[:size]], alone + np.arange(size)


def _prefixes(shared: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """rep, comp, n, need, token, pos: the prefix's tokens that other components hold, and their positions in the document's order."""
    lists = shared.groupBy("rep").agg(F.collect_list("token").alias("tokens"), F.collect_list("c").alias("counts"))
    lists = lists.join(placed.select("rep", "comp", "n"), "rep").select("rep", "comp", "n", "tokens", "counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lorespark.llm import ngram_join as J

        for part in J._parts(batches):
            need, tokens, places = [], [], []
            for n, t, c in zip(part.column("n").to_pylist(), part.column("tokens"), part.column("counts")):
                t, first = np.unique(t.values.to_numpy().view(np.uint64), return_index=True)
                found = J.choose(n, t, c.values.to_numpy()[first], percent)
                for into, x in zip((need, tokens, places), found):
                    into.append(x)
            kept = pa.array([len(t) > 0 for t in tokens], pa.bool_())
            offsets = pa.array(np.cumsum([0, *map(len, places)], dtype=np.int32))
            pos = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(places).astype(np.int64)))
            names = ["rep", "comp", "n"]
            out = [*(part.column(k) for k in names), pa.array(need, pa.int64()), J._as_lists(tokens), pos]
            yield pa.RecordBatch.from_arrays(out, [*names, "need", "token", "pos"]).filter(kept)

    return lists.mapInArrow(run, "rep long, comp long, n long, need long, token array<long>, pos array<long>")


def verified(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold, by exact intersection.

    Sets go to where their partner b is: one copy of it for every MEMBERS of its partners, so a document with very many
    has them dealt over tasks, and a task holds one set of b besides the stream.
    """
    pairs = materialize(pairs)
    sizes = pairs.groupBy("b").agg(F.ceil(F.count("*") / MEMBERS).alias("salts"))
    members = pairs.join(sizes, "b").select(F.col("a").alias("doc_id"), F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), F.col("salts")).alias("salt"), F.lit(1).alias("role"))
    hubs = sizes.select(F.col("b").alias("doc_id"), F.col("b").alias("hub"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    asked = members.union(hubs)
    asked = split_by_keys(_bytes(docs), "doc_id", asked, "doc_id")[0].join(asked, "doc_id").select("hub", "salt", "role", "doc_id", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lorespark.llm import ngram_join as J

        J.only("ngram_join")
        last, found = None, None
        for part in J._parts(batches):
            out = []
            for text in part.column(4).to_pylist():
                if text != last:
                    last, found = text, J.shingles(text, words)
                out.append(found)
            yield pa.RecordBatch.from_arrays([*part.columns[:4], J._as_lists(out)], ["hub", "salt", "role", "doc_id", "tokens"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lorespark.llm import ngram_join as J

        here, theirs = None, []
        for part in J._parts(batches):
            a, b = [], []
            tokens = part.column(4)
            flat, edges = tokens.values.to_numpy(), tokens.offsets.to_numpy()
            for hub, salt, role, doc, i, j in zip(*(c.to_pylist() for c in part.columns[:4]), edges[:-1].tolist(), edges[1:].tolist()):
                if (hub, salt) != here:
                    here, theirs = (hub, salt), []
                own = flat[i:j]
                if role == 0:
                    theirs.append(own)
                elif any(J.similar(own, t, percent) for t in theirs):
                    a.append(doc)
                    b.append(hub)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = asked.mapInArrow(sets, "hub long, salt long, role int, doc_id long, tokens array<long>")
    dealt = dealt.repartition(partitions(session_of(docs)), "hub", "salt").sortWithinPartitions("hub", "salt", "role")
    return materialize(dealt.mapInArrow(meet, "a long, b long").distinct())


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _size_fits(n: str, m: str, percent: int):
    return F.expr(f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m})")


def _meeting_pairs(reps: DataFrame, percent: int) -> DataFrame:
    """Each representative (a) with the smallest ids (b) of its keys, where sizes allow a link and two keys or more are the same."""
    keyed = materialize(reps.select("rep", "n", F.explode("keys").alias("key")))
    first = materialize(keyed.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("first"), F.count("*").alias("c")).where("c > 1").select("key", "first"))
    met = keyed.join(first, "key").where(F.col("rep") != F.col("first.rep")).where(_size_fits("n", "first.n", percent))
    return met.groupBy(F.col("rep").alias("a"), F.col("first.rep").alias("b")).agg(F.count("*").alias("same")).where("same > 1").select("a", "b")


def _candidates(prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs of representatives in different components that share enough prefix tokens.

    The lists hold one row per token, component and size, pre-aggregated before they move, so a token's list is no longer
    for a group of copies. A frequent token's list is split over tasks by adaptive execution.

    Two sets with c tokens in common in their prefixes share at most c and the longer rest, so c must also reach the
    overlap that the threshold asks of their sizes less that rest. Before that, where both lists meet at a token, the two
    sets share at most the tokens before it that other components hold too, and what follows it.
    """
    prefixes = prefixes.withColumn("rest", F.col("n") - _base_column("n", percent) - F.col("need"))
    each = prefixes.select("comp", "n", "need", "rest", F.posexplode(F.arrays_zip("token", "pos")).alias("before", "t")).select("comp", "n", "need", "rest", "before", "t.token", "t.pos")
    key = ["token", "comp", "n"]
    merge = [F.min("need").alias("need"), F.max("rest").alias("rest"), F.min("pos").alias("pos"), F.max("before").alias("before")]
    lists = each.groupBy(*key).agg(*merge)
    several = lists.groupBy("token").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("token")
    # a token of one component alone can match nothing
    shared = materialize(lists.join(several, "token", "left_semi"))
    x, y = shared.alias("x"), shared.alias("y")
    overlap = f"ceil({percent} * ({{}} + {{}}) / {100 + percent}d)"
    can = f"x.comp < y.comp and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
    can += f" and least(x.before, y.before) + least(x.n - x.pos, y.n - y.pos) >= {overlap.format('x.n', 'y.n')}"
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & F.expr(can))
    met = met.groupBy(F.col("x.comp").alias("ca"), F.col("x.n").alias("na"), F.col("y.comp").alias("cb"), F.col("y.n").alias("nb"))
    met = met.agg(F.count("*").alias("common"), F.min(F.least("x.need", "y.need")).alias("need"), F.max("x.rest").alias("ra"), F.max("y.rest").alias("rb"))
    overlap += " - greatest({}, {})"
    close = materialize(met.where("common >= need").where(f"common >= {overlap.format('na', 'nb', 'ra', 'rb')}").select("ca", "na", "cb", "nb"))
    left = prefixes.select(F.col("rep").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("need").alias("needa"), F.col("rest").alias("ra"), F.col("token").alias("pa"))
    right = prefixes.select(F.col("rep").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("need").alias("needb"), F.col("rest").alias("rb"), F.col("token").alias("pb"))
    both = close.join(left, ["ca", "na"]).join(right, ["cb", "nb"]).withColumn("common", F.size(F.array_intersect("pa", "pb")))
    return both.where(F.col("common") >= F.least("needa", "needb")).where(f"common >= {overlap.format('na', 'nb', 'ra', 'rb')}").select("a", "b").distinct()


def _base_column(n: str, percent: int):
    return F.col(n) - F.ceil(F.lit(percent) * F.col(n) / 100)


def ngram_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, share: float = SHARE) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, set_id.

    A document's set: the distinct shingles of so many words between ASCII white space, A-Z lower-cased; with fewer words
    the whole sequence is one; a null or empty text has none and is linked with nothing. Documents are linked when
    100 * intersection >= percent * union; component_id is the smallest doc_id that links reach, the own one included;
    set_id is the smallest doc_id with the same set. Shingles are compared by 64-bit hashes, equal sets by 128 bits.
    Rows that repeat a doc_id are each reported, and are one document where links are followed: what any of its texts is
    linked with is reached from all of them. A row without doc_id is linked with nothing. Texts are read whole. An empty
    table gives no rows. Other columns are ignored.
    """
    ship_code(session_of(docs))
    rows = materialize(_signatures(docs, words, share))
    filled = rows.where("n > 0 and doc_id is not null")
    reps = filled.groupBy("set").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("low").alias("low"), F.first("keys").alias("keys"))
    reps = materialize(reps)
    # a doc_id with several texts links them
    repeated = filled.groupBy("doc_id").agg(F.min("set").alias("s1"), F.max("set").alias("s2")).where("s1 <> s2").select("doc_id")
    own = filled.join(repeated, "doc_id", "left_semi").select("doc_id", "set").join(reps, "set").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    own = materialize(own.where("a <> b").distinct())

    met = verified(docs, _meeting_pairs(reps, percent), words, percent).union(own)
    early = components(met)
    placed = reps.join(early, F.col("rep") == F.col("id"), "left")
    placed = materialize(placed.select("rep", "set", "n", "low", F.coalesce("comp", "rep").alias("comp")))
    # those that have more tokens of their own than a link allows are done
    known = materialize(_shared(_entries(_bytes(docs), placed, words, share), tokens=False).groupBy("rep").agg(F.sum("c").alias("k")))
    own = F.col("low") - F.coalesce("k", F.lit(0))
    placed = materialize(placed.join(known, "rep", "left").where(own <= _base_column("n", percent)).select("rep", "set", "n", "comp"))
    shared = materialize(_shared(_entries(split_by_keys(_bytes(docs), "doc_id", placed, "rep")[0], placed, words, 1.0), tokens=True))
    prefixes = materialize(_prefixes(shared, placed, percent))
    discard(shared)
    late = verified(docs, _candidates(prefixes, percent), words, percent)
    found = materialize(components(met.union(late)).select("id", "comp"))

    classes = reps.select("set", "rep").join(found, F.col("rep") == F.col("id"), "left").select("set", "rep", F.coalesce("comp", "rep").alias("comp"))
    classes = materialize(classes)
    linked = filled.select("doc_id", "n", "set").join(classes, "set").select("doc_id", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.col("rep").alias("set_id"))
    alone = rows.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("set_id"))
    return linked.union(alone)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without those whose component has a smaller doc_id, with docs' own columns, whatever their names.

    Null and empty texts and those without words stay, as do rows without doc_id and rows that repeat a kept doc_id. Ties
    can't be: the smallest doc_id of a component stays. Texts are read whole; an empty table gives no rows.
    """
    gone = materialize(ngram_join(docs, **options).where("component_id <> doc_id").select(F.col("doc_id").alias("gone_id")).distinct())
    perhaps, kept = split_by_keys(docs, "doc_id", gone, "gone_id")
    return kept.unionByName(perhaps.join(gone, perhaps["doc_id"] == gone["gone_id"], "left_anti"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(l[i:i + 4], ' ') AS s FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 4, 1) + 1)) AS i FROM w WHERE len(l) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS same FROM shingles GROUP BY doc_id
), reps AS (
  SELECT same, min(doc_id) AS rep, any_value(n) AS n FROM sizes GROUP BY same
), few AS (
  SELECT rep, n, s FROM reps JOIN shingles ON shingles.doc_id = rep
), links AS (
  SELECT a.rep AS a, b.rep AS b FROM few AS a JOIN few AS b ON a.s = b.s AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT rep, rep AS node FROM reps UNION SELECT reach.rep, ways.b FROM reach JOIN ways ON ways.a = reach.node
), components AS (
  SELECT rep, min(node) AS component_id FROM reach GROUP BY rep
)
SELECT w.doc_id, coalesce(sizes.n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id, coalesce(reps.rep, w.doc_id) AS set_id
FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN reps USING (same) LEFT JOIN components USING (rep)
"""

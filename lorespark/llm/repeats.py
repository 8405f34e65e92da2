"""Repeated passages by an enhanced suffix array over content-chosen suffixes, and their removal.

A stretch of LENGTH bytes holds an anchor chosen by its content alone (anchors.py), so two equal stretches hold the same
anchor at the same place, and only suffixes that start at anchors are needed. Suffixes whose anchors hash alike form a
bucket. Within a bucket, equal contexts (all bytes that a stretch around the anchor can hold) are counted and kept once;
the distinct ones are sorted, their common prefixes give an interval tree by a stack scan, and in each interval the
sorted left contexts tell how far its members extend to the left and where they differ.

A bucket with more distinct contexts than a task should hold is not gathered: its stretches are counted one by one by the bucket, a
64-bit hash and their place, which gives the same answer with bounded tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.anchors import GRAM, anchors
from lorespark.llm.common import discard, materialize, only, partitions, session_of, ship_code, text_of

LENGTH = 200
#: Distinct contexts of a bucket that are gathered: MEAN times a partition's share of all, within these bounds. The upper
#: one bounds a task's memory (about 10 MB), the lower one keeps small buckets together.
MEAN, LEAST_BUCKET, MOST_BUCKET = 3, 1024, 16384
#: What comes before or after a repeat where the text or the context ends: unlike any other.
STOP = 256
GROUPS = {"gram": "long", "around": "long", "repeat": "long", "l": "int", "r": "int"}
STRETCHES = {"gram": "long", "around": "long", "mark": "long", "o": "int", "n": "long", "before": "int", "after": "int"}
PAIRS = {**GROUPS, "n": "long", "before": "int", "after": "int"}


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, dig (tells apart texts under one doc_id) and the text's bytes."""
    text = text_of()
    return docs.select("doc_id", F.xxhash64(text).alias("dig"), text.cast("binary").alias("text"))


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _list(arrays: list[np.ndarray], kind) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).view(kind) if arrays else np.empty(0, kind)))


def _index(docs: DataFrame, length: int) -> DataFrame:
    """Each row's anchors: place, hash of the gram, hash of the context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        from lorespark.llm import repeats as R

        R.only("repeats")
        reach = length - R.GRAM
        for part in R._parts(batches):
            places, grams, around = [], [], []
            for text in part.column(2).to_pylist():
                at, h = R.anchors(text, length)
                places.append(at.astype(np.int32))
                grams.append(h)
                around.append(np.fromiter((xxhash.xxh3_64_intdigest(text[max(0, p - reach) : p + length], min(p, reach)) for p in at.tolist()), np.uint64, len(at)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), R._list(places, np.int32), R._list(grams, np.int64), R._list(around, np.int64)], ["doc_id", "dig", "at", "gram", "around"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _rows(docs).mapInArrow(run, f"doc_id {kind}, dig long, at array<int>, gram array<long>, around array<long>")


def _lcp(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Common prefix of rows of two byte matrices, at most so long."""
    differ = a != b
    first = np.where(differ.any(1), differ.argmax(1), a.shape[1])
    return np.minimum(first, most)


def _matrix(texts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(len(texts), width)


def _intervals(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(least value, first, last) of each interval of the array with these common prefixes of neighbours, by a stack scan; no interval crosses -1."""
    stack: list[tuple[int, int]] = []
    for i, value in enumerate([*values.tolist(), -1], 1):
        first = i - 1
        while stack and stack[-1][0] > value:
            common, first = stack.pop()
            yield common, first, i - 1
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, first))


class Bucket:
    """The enhanced suffix array of one bucket's distinct contexts and its tree of common-prefix intervals."""

    def __init__(self, contexts: list[tuple[bytes, bytes]], length: int = LENGTH):
        self.length = length
        lefts, rights = [left[::-1] for left, _ in contexts], [right for _, right in contexts]
        self.left, self.right = _matrix(lefts, length - GRAM), _matrix(rights, length)
        self.left_size, self.right_size = np.array([*map(len, lefts)]), np.array([*map(len, rights)])
        self.order = np.array(sorted(range(len(rights)), key=rights.__getitem__))
        self.rank = np.empty(len(lefts), np.int64)
        self.rank[sorted(range(len(lefts)), key=lefts.__getitem__)] = np.arange(len(lefts))
        a, b = self.order[:-1], self.order[1:]
        self.lcp = _lcp(self.right[a], self.right[b], np.minimum(self.right_size[a], self.right_size[b]))

    def intervals(self) -> Iterator[tuple[int, int, int]]:
        """(common prefix, first, last) of each interval of the array."""
        return _intervals(self.lcp)

    def extensions(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """Per interval: common prefix, members, how far each extends left with another member, how far all do.

        Beyond the last figure members differ or texts begin: the repeat of all members is maximal there.
        """
        for common, first, last in self.intervals():
            members = self.order[first : last + 1]
            members = members[np.argsort(self.rank[members])]
            a, b = members[:-1], members[1:]
            near = _lcp(self.left[a], self.left[b], np.minimum(self.left_size[a], self.left_size[b]))
            yield common, members, np.maximum(np.append(near, 0), np.insert(near, 0, 0)), int(near.min())

    def covered(self) -> tuple[np.ndarray, np.ndarray]:
        """How far left and right of the anchor each context lies in a stretch that another one has too; (0, 0): nowhere."""
        to_left, to_right = np.zeros((2, len(self.order)), np.int64)
        for common, members, extends, _ in self.extensions():
            long = extends + common >= self.length
            hit = members[long]
            to_left[hit] = np.maximum(to_left[hit], extends[long])
            to_right[hit] = np.maximum(to_right[hit], common)
        return to_left, to_right

    def maximal(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(bytes left of the anchor, bytes from it on, all members) of each maximal repeat of at least the length.

        In an interval of the right sides, the left sides have intervals of their own; one whose members all go on alike to the
        right belongs to a longer common prefix.
        """
        place = np.empty(len(self.order), np.int64)
        place[self.order] = np.arange(len(self.order))
        for common, first, last in self.intervals():
            members = self.order[first : last + 1]
            members = members[np.argsort(self.rank[members])]
            a, b = members[:-1], members[1:]
            near = _lcp(self.left[a], self.left[b], np.minimum(self.left_size[a], self.left_size[b]))
            for every, i, j in _intervals(np.where(near + common >= self.length, near, -1)):
                some = members[i : j + 1]
                at = place[some]
                if self.lcp[at.min() : at.max()].min() == common:
                    yield every, common, some


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, list]]]:
    """Runs of equal gram from sorted batches: the columns of each."""
    gram, held = None, []

    def columns() -> dict[str, list]:
        table = pa.Table.from_batches(held)
        return {k: table.column(k).to_pylist() for k in table.column_names}

    for batch in batches:
        grams = batch.column(batch.schema.get_field_index("gram")).to_numpy()
        edges = [0, *(np.flatnonzero(grams[1:] != grams[:-1]) + 1).tolist(), len(grams)]
        for i, j in zip(edges, edges[1:]):
            if i == j:
                continue
            if held and grams[i] != gram:
                yield gram, columns()
                held = []
            gram = int(grams[i])
            held.append(batch.slice(i, j - i))
    if held:
        yield gram, columns()


class _Texts:
    """Where repeats are looked for, and the steps that find them."""

    def __init__(self, docs: DataFrame, length: int):
        ship_code(session_of(docs))
        self.docs, self.length, self.kind = docs, length, docs.schema["doc_id"].dataType.simpleString()
        index = materialize(_index(docs, length))
        each = index.select("doc_id", "dig", F.inline(F.arrays_zip("at", "gram", "around")))
        several = materialize(each.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram"))
        self.shared = materialize(each.join(several, "gram"))
        discard(index)
        first = F.min(F.struct("doc_id", "dig", "at")).alias("first")
        contexts = self.shared.groupBy("gram", "around").agg(F.count("*").alias("n"), first)
        self.contexts = materialize(contexts)
        sizes = self.contexts.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1")
        self.wanted = materialize(self.contexts.join(materialize(sizes), "gram").select("gram", "m", "n", "first.*"))
        self.bucket = min(MOST_BUCKET, max(LEAST_BUCKET, MEAN * self.wanted.count() // partitions(session_of(docs))))

    def whole(self) -> DataFrame:
        """The contexts that occur more than once: every stretch in them is repeated."""
        several = self.contexts.where("n > 1").select("gram", "around")
        reach = self.length - GRAM
        found = self.shared.join(several, ["gram", "around"])
        return found.select("doc_id", "dig", F.greatest(F.col("at") - reach, F.lit(0)).alias("start"), (F.col("at") + self.length).alias("stop"))

    def fetched(self, wanted: DataFrame | None = None, *more: str) -> DataFrame:
        """One occurrence of each wanted context, with its bytes: of each distinct one of buckets with several, where none are given."""
        length, keys = self.length, ["gram", "m", "n", *more]
        wanted = self.wanted if wanted is None else wanted
        asked = wanted.groupBy(F.col("doc_id").alias("_id"), F.col("dig").alias("_dig")).agg(F.collect_list(F.struct(*keys, "at")).alias("asked"))
        texts = _rows(self.docs)
        joined = texts.join(asked, texts["doc_id"].eqNullSafe(asked["_id"]) & (texts["dig"] == asked["_dig"])).select("doc_id", "dig", "text", "asked")

        each = joined.select("doc_id", "dig", "text", F.explode("asked").alias("a")).select(*[f"a.{k}" for k in keys], "doc_id", "dig", "a.at", "text")
        start = F.greatest(F.col("at") - (length - GRAM), F.lit(0))
        left, right = F.substring("text", start + 1, F.col("at") - start), F.substring("text", F.col("at") + 1, F.lit(length))
        return each.select(*keys, "doc_id", "dig", "at", left.alias("left"), right.alias("right"))

    def _sorted(self, fetched: DataFrame) -> DataFrame:
        small = fetched.where(F.col("m") <= self.bucket)
        return small.repartition(partitions(session_of(small)), "gram").sortWithinPartitions("gram")

    def by_tree(self, fetched: DataFrame) -> DataFrame:
        length = self.length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from lorespark.llm import repeats as R

            names, kinds = ["doc_id", "dig", "start", "stop"], None
            out: list[tuple] = []
            for _, rows in R._buckets(batches):
                to_left, to_right = R.Bucket(list(zip(rows["left"], rows["right"])), length).covered()
                found = zip(rows["doc_id"], rows["dig"], rows["at"], rows["n"], to_left.tolist(), to_right.tolist())
                out += [(i, dig, at - a, at + b) for i, dig, at, n, a, b in found if b and n == 1]
                if len(out) > 10_000:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))), schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))), schema)

        id_kind = pa.int64() if self.kind == "bigint" else pa.int32() if self.kind == "int" else pa.string()
        schema = pa.schema([("doc_id", id_kind), ("dig", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])
        return self._sorted(fetched).mapInArrow(run, f"doc_id {self.kind}, dig long, start int, stop int")

    def by_stretch(self, fetched: DataFrame) -> DataFrame:
        length = self.length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import xxhash

            from lorespark.llm import repeats as R

            for part in R._parts(batches, 64):
                ids, digs, ats, offsets, grams, marks = [], [], [], [], [], []
                for r in part.to_pylist():
                    both, edge = r["left"] + r["right"], len(r["left"])
                    for o in range(max(0, length - len(r["right"])), edge + 1):
                        ids.append(r["doc_id"])
                        digs.append(r["dig"])
                        ats.append(r["at"])
                        offsets.append(o)
                        grams.append(r["gram"])
                        # a stretch may hold several anchors: it counts once for each gram and place of the anchor
                        marks.append(xxhash.xxh3_64_intdigest(both[edge - o : edge - o + length], r["gram"] & 0xFFFFFFFFFFFFFFFF))
                yield pa.RecordBatch.from_arrays([pa.array(ids, part.schema.field("doc_id").type), pa.array(digs, pa.int64()), pa.array(ats, pa.int32()), pa.array(offsets, pa.int16()), pa.array(grams, pa.int64()), pa.array(np.array(marks, np.uint64).view(np.int64))], ["doc_id", "dig", "at", "o", "gram", "mark"])

        each = fetched.where(F.col("m") > self.bucket).mapInArrow(run, f"doc_id {self.kind}, dig long, at int, o short, gram long, mark long")
        again = materialize(each.groupBy("gram", "mark", "o").agg(F.count("*").alias("c")).where("c > 1").select("gram", "mark", "o"))
        # all stretches at an anchor hold its gram, so their union has no gap
        found = each.join(again, ["gram", "mark", "o"]).groupBy("doc_id", "dig", "at").agg(F.max("o").alias("far"), F.min("o").alias("near"))
        return found.select("doc_id", "dig", (F.col("at") - F.col("far")).alias("start"), (F.col("at") + length - F.col("near")).alias("stop"))

    def groups_by_tree(self, fetched: DataFrame) -> DataFrame:
        """Of small buckets: gram, around, repeat, l, r, a row for each context that holds the repeat l bytes left of the anchor and r from it on."""
        length = self.length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from lorespark.llm import repeats as R

            out: list[tuple] = []
            for gram, rows in R._buckets(batches):
                # rows that repeat a doc_id are fetched each; a context that occurs again stands twice, as all of it is repeated
                once = list({x[0]: x for x in zip(rows["around"], rows["left"], rows["right"], rows["n"])}.values())
                held = [*once, *(x for x in once if x[3] > 1)]
                for left, right, members in R.Bucket([x[1:3] for x in held], length).maximal():
                    some = held[members[0]]
                    if (repeat := R.repeat_id(some[1], some[2], left, right, length)) is not None:
                        out += [(gram, around, repeat, left, right) for around in {held[i][0] for i in members.tolist()}]
                    if len(out) > 10_000:
                        yield R._table(out, GROUPS)
                        out = []
            if out:
                yield R._table(out, GROUPS)

        return self._sorted(fetched).mapInArrow(run, _sql(GROUPS))

    def groups_by_stretch(self, fetched: DataFrame) -> DataFrame:
        """groups_by_tree() of large buckets, of which nothing is gathered.

        A repeat of l and r bytes ends to the right where its stretch with r bytes from the anchor on goes on unlike, and to
        the left where that with l bytes before the anchor does. Such ends are found stretch by stretch; each pair of a
        context's ends is then a repeat when the contexts that share it go on unlike on both sides.
        """
        length = self.length
        large = fetched.where(F.col("m") > self.bucket)

        def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import xxhash

            from lorespark.llm import repeats as R

            for part in R._parts(batches, 64):
                out = []
                for r in part.to_pylist():
                    for o in range(max(0, length - len(r["right"])), len(r["left"]) + 1):
                        before, after, w = R.around_of(r["left"], r["right"], o, length - o)
                        mark = R._signed(xxhash.xxh3_64_intdigest(w, r["gram"] & 0xFFFFFFFFFFFFFFFF))
                        out.append((r["gram"], r["around"], mark, o, r["n"], before, after))
                yield R._table(out, STRETCHES)

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from lorespark.llm import repeats as R

            for part in R._parts(batches, 64):
                out = []
                for row in part.to_pylist():
                    for left in row["lefts"]:
                        for right in row["rights"]:
                            if left + right >= length and (repeat := R.repeat_id(row["left"], row["right"], left, right, length)) is not None:
                                before, after, _ = R.around_of(row["left"], row["right"], left, right)
                                out.append((row["gram"], row["around"], repeat, left, right, row["n"], before, after))
                    if len(out) > 10_000:
                        yield R._table(out, PAIRS)
                        out = []
                yield R._table(out, PAIRS)

        unlike = lambda side: (F.min(side) != F.max(side)) | (F.max(side) == STOP)
        each = large.mapInArrow(stretches, _sql(STRETCHES))
        ends = each.groupBy("gram", "mark", "o").agg(F.sum("n").alias("c"), unlike("before").alias("to_left"), unlike("after").alias("to_right"))
        ends = materialize(ends.where("c > 1 and (to_left or to_right)").drop("c"))
        ends = each.join(ends, ["gram", "mark", "o"]).groupBy("gram", "around")
        ends = ends.agg(F.collect_set(F.when(F.col("to_left"), F.col("o"))).alias("lefts"), F.collect_set(F.when(F.col("to_right"), length - F.col("o"))).alias("rights"))
        asked = large.dropDuplicates(["gram", "around"]).select("gram", "around", "n", "left", "right").join(ends, ["gram", "around"])
        found = materialize(asked.mapInArrow(pairs, _sql(PAIRS)))
        key = ["gram", "repeat", "l", "r"]
        groups = found.groupBy(*key).agg(F.sum("n").alias("c"), unlike("before").alias("to_left"), unlike("after").alias("to_right"))
        return found.join(materialize(groups.where("c > 1 and to_left and to_right").select(*key)), key).select(*GROUPS)


def _sql(columns: dict[str, str]) -> str:
    return ", ".join(f"{k} {v}" for k, v in columns.items())


def _table(rows: list[tuple], columns: dict[str, str]) -> pa.RecordBatch:
    schema = pa.schema([(k, pa.int64() if v == "long" else pa.int32()) for k, v in columns.items()])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(columns), schema.types)], schema=schema)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def around_of(left: bytes, right: bytes, to_left: int, to_right: int) -> tuple[int, int, bytes]:
    """The byte before and the byte after the stretch of so many bytes on each side of the anchor (STOP: none), and the stretch."""
    before = left[-to_left - 1] if to_left < len(left) else STOP
    after = right[to_right] if to_right < len(right) else STOP
    return before, after, left[len(left) - to_left :] + right[:to_right]


def repeat_id(left: bytes, right: bytes, to_left: int, to_right: int, length: int) -> int | None:
    """A hash of the repeat and its anchor's place. None where no stretch inside it chooses the anchor: other bytes do then, not around all of its
    occurrences, and the repeat is found with all of them at the anchors of its own."""
    import xxhash

    found = left[len(left) - to_left :] + right[:to_right]
    return _signed(xxhash.xxh3_64_intdigest(found, to_left)) if to_left in anchors(found, length)[0] else None


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, dig, spans: for rows with repeated stretches, the (start, stop) byte spans around their anchors, which may overlap."""
    found = _Texts(docs, length)
    fetched = materialize(found.fetched())
    spans = found.whole().unionByName(found.by_tree(fetched)).unionByName(found.by_stretch(fetched))
    return spans.groupBy("doc_id", "dig").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def maximal_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The maximal repeat groups: bucket, repeat, length, doc_id, dig, start, one row per occurrence, with all occurrences.

    A group is a string of at least length bytes around an anchor of its own (bucket: the gram's hash) that occurs more than
    once and goes on unlike on both sides, or reaches the end of a text or of what a context holds: a longer repeat gives a
    group for each of its anchors. repeat tells a bucket's groups apart. Rows that repeat a doc_id are occurrences each.
    """
    found = _Texts(docs, length)
    sizes = materialize(found.contexts.groupBy("gram").agg(F.count("*").alias("m")))
    wanted = materialize(found.contexts.join(sizes, "gram").select("gram", "around", "m", "n", "first.*"))
    fetched = materialize(found.fetched(wanted, "around"))
    groups = materialize(found.groups_by_tree(fetched).unionByName(found.groups_by_stretch(fetched)))
    places = found.shared.join(groups, ["gram", "around"])
    return places.select(F.col("gram").alias("bucket"), "repeat", (F.col("l") + F.col("r")).alias("length"), "doc_id", "dig", (F.col("at") - F.col("l")).alias("start"))


def without(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The text without the union of spans, and the number of maximal runs removed."""
    kept, runs, at = [], 0, 0
    stop = -1
    for a, b in sorted(spans):
        if a > stop:
            kept.append(text[at:a])
            runs += 1
        stop = max(stop, b)
        at = max(at, min(stop, len(text)))
    kept.append(text[at:])
    return b"".join(kept), runs


def dedup_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay).

    A byte goes when a string of length bytes that covers it also starts anywhere else, in the same text too; matches
    never cross texts and are judged on the input. A null or empty text has no bytes and keeps none; shorter texts stay
    whole; repeated rows are removed whole when they are long enough. An empty table gives no rows. Other columns are
    ignored.
    """
    spans = repeated_spans(docs, length)
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("dig").alias("_dig"), "spans")
    texts = _rows(docs)
    joined = texts.join(spans, texts["doc_id"].eqNullSafe(spans["_id"]) & (texts["dig"] == spans["_dig"]), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lorespark.llm import repeats as R

        for part in R._parts(batches):
            sizes, removed, runs, kept = [], [], [], []
            for row in part.to_pylist():
                left, n = R.without(row["text"], [(s["start"], s["stop"]) for s in row["spans"]]) if row["spans"] else (row["text"], 0)
                sizes.append(len(row["text"]))
                removed.append(len(row["text"]) - len(left))
                runs.append(n)
                kept.append(left)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH b AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), places AS (
  SELECT doc_id, unnest(range(n - 199)) AS i, h FROM b WHERE n >= 200
), wins AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM places
), starts AS (
  SELECT doc_id, i FROM wins QUALIFY count(*) OVER (PARTITION BY k) > 1
), marked AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 200 THEN 0 ELSE 1 END AS new FROM starts WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), spans AS (
  SELECT doc_id, run, min(i) AS a, max(i) + 200 AS e FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM marked) GROUP BY doc_id, run
), parts AS (
  SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM spans
), left_over AS (
  SELECT b.doc_id, string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) || substr(any_value(h), 2 * max(e) + 1) AS kept, sum(e - a) AS removed, count(*) AS n_spans FROM parts JOIN b USING (doc_id) GROUP BY b.doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM b LEFT JOIN left_over USING (doc_id)
"""

"""Toxicity: a convolutional text classifier with hashed word embeddings, trained in numpy, with thresholds by language.

All labelled rows that are not held out are learned. Few are learned in the driver. More are learned where they lie: tasks train the same networks
on their parts of the rows, the networks' changes are averaged by a shuffle, and so on for some rounds; what reaches the driver is of the networks' size.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.llm.common import materialize, only, session_of, shared_folder, ship_code, split_by_keys, text_of

#: Hash space of words; embedding size; filter widths; filters of each width.
SPACE, DIM, WIDTHS, FILTERS = 1 << 20, 8, (1, 2, 3), 8
#: Labelled rows of each class up to which the driver learns; with more of one class tasks do.
DRIVER_ROWS = 4000
#: Labelled rows of a part, and the most parts: a part has more rows where those would be too many. Rows that a task learns from at once.
PART_ROWS, PARTS, CHUNK = 8000, 24, 4096
#: How often parts' networks are averaged, and how often a part's rows are gone through before that.
ROUNDS, LOCAL_EPOCHS = 4, 2
#: Rows of the embedding that are averaged together; steps between 0 and 1 that a threshold found in parts can take.
ROWS_AT_ONCE, STEPS = 4096, 10_000
#: A word has an embedding if it stands in so many labelled texts; others count as padding.
MIN_TEXTS = 3
EPOCHS, BATCH, RATE, SEED = 12, 64, 0.02, 7
#: Networks whose mean scores; each leaves out one part of the labelled rows, on which it is calibrated.
FOLDS = 3
#: A score from here on is predicted as toxic, where a language has no threshold of its own.
THRESHOLD = 0.3
#: A language gets its own threshold with so many positives among the labelled rows; the others share one, found on their
#: rows together, or on all languages' rows where those have too few.
MIN_POSITIVE = 20
#: The key of the shared threshold: no language's name.
OTHERS = None
#: Bytes of text that are scored at once: the windows of so many stay in a core's cache.
AT_ONCE = 200_000
#: ASCII punctuation, which words lose at their ends.
_EDGE = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())


def slots(text: bytes) -> np.ndarray:
    """The slot of each word between ASCII white space, without ASCII punctuation at its ends, A-Z lower-cased; 0 where nothing is left of it."""
    words = text.lower().split()
    return (np.fromiter(map(zlib.crc32, map(bytes.strip, words, repeat(_EDGE))), np.uint32, len(words)) & np.uint32(SPACE - 1)).view(np.int32)


class Network:
    """Embeddings, one convolution per width, maximum over all positions, one logistic output.

    A text is followed by zero rows, as many as the widest filter needs, so no window reaches into the next text and a
    text without words has its score too.
    """

    def __init__(self, rows: int, rng: np.random.Generator):
        f = np.float32
        self.embed = np.concatenate([np.zeros((1, DIM)), rng.normal(0, 0.1, (rows - 1, DIM))]).astype(f)
        self.filters = [rng.normal(0, 0.3, (w * DIM, FILTERS)).astype(f) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, f) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(f)
        self.base = np.zeros(1, f)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.out, self.base]

    def _laid_out(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        gap = max(WIDTHS)
        starts = np.cumsum([0, *(len(t) + gap for t in texts)])
        flat = np.zeros(starts[-1], np.int32)
        for s, t in zip(starts, texts):
            flat[s : s + len(t)] = t
        return flat, starts[:-1]

    def forward(self, texts: list[np.ndarray], keep: bool = False):
        """Scores; with keep also what the gradient needs: rows, positions of the maxima, pooled values."""
        flat, starts = self._laid_out(texts)
        most = max(WIDTHS)
        stops = np.append(starts[1:], len(flat)) - (most - 1)
        # a row for each filter and place in the window, so that what follows runs along rows; the places at one distance stand together
        weights = np.concatenate([k[j * DIM : (j + 1) * DIM].T for j in range(most) for w, k in zip(WIDTHS, self.filters) if w > j])
        each = weights @ np.take(self.embed, flat, 0).T
        n, at = len(flat), len(WIDTHS) * FILTERS
        y = each[:at]
        for j in range(1, most):
            more = FILTERS * sum(w > j for w in WIDTHS)
            y[-more:, : n - j] += each[at : at + more, j:]
            at += more
        if keep:
            places = np.stack([s + y[:, s:e].argmax(1) for s, e in zip(starts.tolist(), stops.tolist())])
            top = np.take_along_axis(y, places.T, 1).T
        else:
            # the last starts before the next text would reach into it
            for j in range(most - 1):
                y[:, stops + j] = -np.inf
            places, top = None, np.maximum.reduceat(y, starts, 1).T
        z = np.maximum(top + np.concatenate(self.bias), 0)
        score = 1 / (1 + np.exp(-np.clip(z @ self.out + self.base[0], -30, 30)))
        return (score, flat, places, z) if keep else score

    def gradients(self, texts: list[np.ndarray], labels: np.ndarray) -> list[np.ndarray]:
        score, flat, places, z = self.forward(texts, keep=True)
        error = ((score - labels) / len(texts)).astype(np.float32)
        d_z = error[:, None] * self.out * (z > 0)
        d_embed, d_filters, d_bias = np.zeros_like(self.embed), [], []
        for i, (w, k) in enumerate(zip(WIDTHS, self.filters)):
            at = places[:, i * FILTERS : (i + 1) * FILTERS]
            d = d_z[:, i * FILTERS : (i + 1) * FILTERS]
            d_k = np.zeros_like(k)
            for j in range(w):
                rows = flat[at + j]
                part = k[j * DIM : (j + 1) * DIM]
                d_k[j * DIM : (j + 1) * DIM] = np.einsum("tfd,tf->df", self.embed[rows], d)
                np.add.at(d_embed, rows.ravel(), (d[:, :, None] * part.T[None]).reshape(-1, DIM))
            d_filters.append(d_k)
            d_bias.append(d.sum(0))
        d_embed[0] = 0
        return [d_embed, *d_filters, *d_bias, z.T @ error, np.array([error.sum()], np.float32)]


def fit(texts: list[np.ndarray], labels: np.ndarray, rows: int) -> Network:
    """Adam on the log loss, in a fixed order: the same rows give the same network."""
    rng = np.random.default_rng(SEED)
    net = Network(rows, rng)
    _learn(net, texts, labels, EPOCHS, rng)
    return net


def _learn(net: Network, texts: list[np.ndarray], labels: np.ndarray, epochs: int, rng: np.random.Generator, lazy: bool = False) -> None:
    """Lazy: a step moves the embeddings of its own texts' words only, so its time does not grow with the vocabulary."""
    first, second = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()]
    step, rows, place = 0, slice(None), np.zeros(len(net.embed), np.int32)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            batch, whole = [texts[i] for i in some], net.embed
            step += 1
            if lazy:
                met = np.zeros(len(whole), bool)
                met[np.concatenate(batch)] = met[0] = True
                rows = np.flatnonzero(met)
                place[rows] = np.arange(len(rows))
                batch, net.embed = [place[t] for t in batch], np.take(whole, rows, 0)
            slopes = net.gradients(batch, labels[some])
            for k, (p, g, m, v) in enumerate(zip(net.parameters(), slopes, first, second)):
                if lazy and k == 0:
                    some_m, some_v = np.take(m, rows, 0), np.take(v, rows, 0)
                    _step(p, g, some_m, some_v, step)
                    whole[rows], m[rows], v[rows] = p, some_m, some_v
                else:
                    _step(p, g, m, v, step)
            net.embed = whole


def _step(p: np.ndarray, g: np.ndarray, m: np.ndarray, v: np.ndarray, step: int) -> None:
    """One step of Adam on p, in place, m and v too; g is used up."""
    change = g - m
    change *= 0.1
    m += change
    g *= g
    g -= v
    g *= 0.001
    v += g
    np.divide(v, 1 - 0.999**step, out=g)
    np.sqrt(g, out=g)
    g += 1e-8
    np.divide(m, 1 - 0.9**step, out=change)
    change *= RATE
    change /= g
    p -= change


def _best_threshold(score: np.ndarray, label: np.ndarray) -> float:
    """The cut with the best F1; among equal ones the middle of the gap above it."""
    order = np.argsort(-score, kind="stable")
    hits = np.cumsum(label[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + label.sum())
    k = int(f1.argmax())
    below = score[order[k + 1]] if k + 1 < len(order) else 0.0
    return float((score[order[k]] + below) / 2)


def _calibrated(score: np.ndarray, label: np.ndarray, lang: np.ndarray) -> dict[str | None, float]:
    """The best cut, above or below THRESHOLD, of each language with enough positives, and the one that all others share."""
    found: dict[str | None, float] = {}
    enough = lambda here: label[here].sum() >= MIN_POSITIVE
    others = np.ones(len(lang), bool)
    for name in sorted(set(lang)):
        here = lang == name
        if name and enough(here):
            found[name] = _best_threshold(score[here], label[here])
            others &= ~here
    for here in (others, np.ones(len(lang), bool)):
        if enough(here) and OTHERS not in found:
            found[OTHERS] = _best_threshold(score[here], label[here])
    return found


class Classifier:
    """What scoring needs: the networks, and the row of each slot (0: none). Its size does not depend on the input's."""

    def __init__(self, nets: list[Network], rows: np.ndarray, thresholds: dict[str | None, float]):
        self.nets, self.rows, self.thresholds = nets, rows, thresholds

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Scores; so many texts go through the network together that some MB of windows are held, however long texts are."""
        found, at = [np.empty(0)], 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) < AT_ONCE):
                size += len(texts[stop])
                stop += 1
            some = [self.rows[slots(t)] for t in texts[at:stop]]
            found.append(np.mean([net.forward(some) for net in self.nets], 0))
            at = stop
        return np.concatenate(found).astype(np.float64)

    def threshold(self, lang: str | None) -> float:
        return self.thresholds.get(lang, self.thresholds.get(OTHERS, THRESHOLD))


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def _known(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))


def _fold(doc_id: int) -> int:
    return zlib.crc32(f"c{doc_id}".encode()) % FOLDS


def _slots_of(docs: DataFrame) -> DataFrame:
    """doc_id, lang, slots of each row."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lorespark.llm import toxicity as T

        for batch in batches:
            found = pa.array([T.slots(t) for t in batch.column(2).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), found], ["doc_id", "lang", "slots"])

    return docs.select("doc_id", lang.alias("lang"), text_of().cast("binary").alias("text")).mapInArrow(run, "doc_id long, lang string, slots array<int>")


def sample(docs: DataFrame, labels: DataFrame, bound: int) -> dict | None:
    """All labelled rows but those held out: doc_id, toxic, lang, slots. None where a label has more than bound of them, which are too many for the driver."""
    known = _known(labels)
    if known.groupBy("toxic").count().where(F.col("count") > bound).count():
        return None
    # at most twice the bound's rows are sent to every task
    few = F.broadcast(known)
    got = _slots_of(docs.join(few, "doc_id", "left_semi")).join(few, "doc_id").select("doc_id", "toxic", "lang", "slots").toArrow()
    order = np.lexsort((got.column("doc_id").to_numpy(),))
    return got.take(pa.array(order)).to_pydict()


def _parts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """toxic, lang, fold, slots of all labelled rows but those held out, in parts by a hash of doc_id: a partition each, in a fixed order."""
    known = _known(labels)
    n = min(PARTS, max(1, -(-known.count() // PART_ROWS)))
    # only documents that may have a label are shuffled, without their texts
    rows, _ = split_by_keys(docs.where("doc_id is not null"), "doc_id", known, "doc_id")
    rows = _slots_of(rows).repartition(n, "doc_id").join(known.repartition(n, "doc_id"), "doc_id").repartition(n, "doc_id")
    fold = F.pmod(F.crc32(F.concat(F.lit("c"), F.col("doc_id").cast("string")).cast("binary")), F.lit(FOLDS)).cast("int")
    rows = rows.select("doc_id", "toxic", F.coalesce("lang", F.lit("")).alias("lang"), fold.alias("fold"), "slots")
    placed = rows.sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", F.hash("slots")).drop("doc_id")
    spark = session_of(docs)
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return placed.checkpoint()


def _chunks(batches: Iterator[pa.RecordBatch], index: np.ndarray) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, list[str]]]:
    """Texts, labels, folds and languages of up to CHUNK rows (and a batch) at once."""
    held: list[pa.RecordBatch] = []

    def joined():
        table = pa.Table.from_batches(held)
        slot = table.column("slots").combine_chunks()
        edges, flat = slot.offsets.to_numpy(), slot.values.to_numpy()
        texts = [index[flat[a:b]] for a, b in zip(edges[:-1], edges[1:])]
        return texts, table.column("toxic").to_numpy().astype(np.float32), table.column("fold").to_numpy(), table.column("lang").to_pylist()

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK:
            yield joined()
            held = []
    if sum(b.num_rows for b in held):
        yield joined()


def _learn_chunk(net: Network, texts: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Goes through these rows LOCAL_EPOCHS times, with the embeddings of their own words only, which it returns the rows of."""
    met = np.zeros(len(net.embed), bool)
    met[np.concatenate(texts)] = met[0] = True
    own = np.flatnonzero(met)
    place = np.zeros(len(met), np.int32)
    place[own] = np.arange(len(own))
    small = Network(len(own), rng)
    small.embed, small.filters, small.bias, small.out, small.base = net.embed[own], net.filters, net.bias, net.out, net.base
    _learn(small, [place[t] for t in texts], labels, LOCAL_EPOCHS, rng, lazy=True)
    net.embed[own] = small.embed
    return own


def _copy(net: Network) -> Network:
    same = Network(1, np.random.default_rng(0))
    same.embed, same.filters, same.bias, same.out, same.base = net.embed.copy(), [f.copy() for f in net.filters], [b.copy() for b in net.bias], net.out.copy(), net.base.copy()
    return same


def _round(parts: DataFrame, index: np.ndarray, nets: list[Network], folds: list[int], number: int) -> None:
    """Each part's rows change a copy of each network, but for the rows of its fold; the mean of the changes is added to it.

    A word's embedding has the mean over the parts in which it stands. Parts are added in their order, so reruns agree.
    """
    shared = session_of(parts).sparkContext.broadcast((index, nets, folds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from lorespark.llm import toxicity as T

        T.only("toxicity")
        index, nets, folds = shared.value
        part = TaskContext.get().partitionId()
        mine = [T._copy(net) for net in nets]
        rng = np.random.default_rng([T.SEED, number, part])
        met = [np.zeros(len(net.embed), bool) for net in nets]
        some = False
        for texts, labels, fold, _ in T._chunks(batches, index):
            some = True
            for net, k, seen in zip(mine, folds, met):
                use = np.flatnonzero(fold != k)
                if len(use):
                    seen[T._learn_chunk(net, [texts[i] for i in use], labels[use], rng)] = True
        if not some:
            return
        for i, (net, old, seen) in enumerate(zip(mine, nets, met)):
            small = np.concatenate([(a - b).ravel() for a, b in zip(net.parameters()[1:], old.parameters()[1:])])
            blocks = [(-1, small, np.ones(1, bool))]
            for at in range(0, len(seen), T.ROWS_AT_ONCE):
                here = slice(at, at + T.ROWS_AT_ONCE)
                if seen[here].any():
                    blocks.append((at, net.embed[here] - old.embed[here], seen[here]))
            for at, change, seen_here in blocks:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int32()), pa.array([at]), pa.array([part], pa.int32()), pa.array([change.astype(np.float32).tobytes()], pa.binary()), pa.array([seen_here.tobytes()], pa.binary())],
                    ["net", "at", "part", "change", "seen"],
                )

    def mean(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        changes = [np.frombuffer(c, np.float32) for c in table.column("change").to_pylist()]
        seen = [np.frombuffer(c, bool) for c in table.column("seen").to_pylist()]
        total = np.sum([c.reshape(len(m), -1) for c, m in zip(changes, seen)], 0, dtype=np.float64) / np.maximum(np.sum(seen, 0), 1)[:, None]
        return pa.table({"net": table.column("net")[:1], "at": table.column("at")[:1], "change": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    changes = parts.mapInArrow(run, "net int, at long, part int, change binary, seen binary")
    got = changes.groupBy("net", "at").applyInArrow(mean, "net int, at long, change binary").toArrow()
    for i, at, change in zip(*(got.column(c).to_pylist() for c in ("net", "at", "change"))):
        values = np.frombuffer(change, np.float32)
        if at >= 0:
            values = values.reshape(-1, DIM)
            nets[i].embed[at : at + len(values)] += values
            continue
        for p in nets[i].parameters()[1:]:
            p += values[: p.size].reshape(p.shape)
            values = values[p.size :]
    shared.unpersist()


def _let_go(docs: DataFrame) -> None:
    """Shuffle files of finished steps, which would fill the disks."""
    gc.collect()
    session_of(docs)._jvm.System.gc()


def _cuts(scored: DataFrame) -> dict[str | None, float]:
    """_calibrated over a table (lang, toxic, score): all rows are counted, in STEPS steps of the score."""
    step = F.least(F.floor(F.col("score") * STEPS), F.lit(STEPS - 1))
    counts = materialize(scored.groupBy("lang", step.alias("step")).agg(F.count("*").alias("n"), F.sum("toxic").alias("hits")))
    enough = counts.groupBy("lang").agg(F.sum("hits").alias("all")).where(F.col("all") >= MIN_POSITIVE).where("lang != ''").select("lang", F.lit(True).alias("own"))
    counts = materialize(counts.join(enough, "lang", "left").withColumn("own", F.coalesce("own", F.lit(False))))

    def best(rows: DataFrame) -> dict[str, float]:
        rows = rows.groupBy("name", "step").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
        name = Window.partitionBy("name")
        down = name.orderBy(F.desc("step"))
        f1 = 2 * F.sum("hits").over(down) / (F.sum("n").over(down) + F.sum("hits").over(name))
        cut = (F.col("step") + F.coalesce(F.lead("step").over(down) + 1, F.lit(0))) / (2 * STEPS)
        rows = rows.select("name", "step", f1.alias("f1"), cut.alias("cut"), F.sum("hits").over(name).alias("all")).where(F.col("all") >= MIN_POSITIVE)
        return {r.name: r.cut for r in rows.groupBy("name").agg(F.max_by("cut", F.struct("f1", "step")).alias("cut")).select("name", "cut").collect()}

    found: dict[str | None, float] = dict(best(counts.where("own").withColumn("name", F.col("lang"))))
    for rest in (counts.where("not own"), counts):
        shared = best(rest.withColumn("name", F.lit("")))
        if shared and OTHERS not in found:
            found[OTHERS] = shared[""]
    return found


def _train_in_parts(docs: DataFrame, labels: DataFrame) -> Classifier:
    """train() for rows that the driver can't hold: the same networks, folds and cuts, from all rows, by tasks."""
    parts = _parts(docs, labels)
    _let_go(docs)

    def texts_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lorespark.llm import toxicity as T

        seen = np.zeros(T.SPACE, np.int32)
        for texts, _, _, _ in T._chunks(batches, np.arange(T.SPACE, dtype=np.int32)):
            for t in texts:
                seen[np.unique(t)] += 1
        found = np.flatnonzero(seen)
        for at in range(0, len(found), 1 << 16):
            some = found[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some].astype(np.int64))], ["slot", "n"])

    known = parts.mapInArrow(texts_with, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_TEXTS).where("slot > 0")
    known = np.sort(known.select("slot").toArrow().column(0).to_numpy())
    index = np.zeros(SPACE, np.int32)
    index[known] = np.arange(1, 1 + len(known))
    toxic = {r.fold: (r.n, r.toxic) for r in parts.groupBy("fold").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).collect()}
    whole = all(k in toxic and sum(t for f, (_, t) in toxic.items() if f != k) for k in range(FOLDS))
    folds = list(range(FOLDS)) if whole else [-1]
    nets = [Network(len(known) + 1, np.random.default_rng(SEED)) for _ in folds]
    for number in range(ROUNDS):
        _round(parts, index, nets, folds, number)
        _let_go(docs)
    if not whole:
        return Classifier(nets, index, {})
    shared = session_of(docs).sparkContext.broadcast((index, nets))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lorespark.llm import toxicity as T

        index, nets = shared.value
        for batch in batches:
            for texts, label, fold, lang in T._chunks(iter([batch]), index):
                found = np.zeros(len(texts))
                for k, net in enumerate(nets):
                    for i in np.array_split(np.flatnonzero(fold == k), 8):
                        if len(i):
                            found[i] = net.forward([texts[j] for j in i])
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(label.astype(np.int64)), pa.array(found)], ["lang", "toxic", "score"])

    return Classifier(nets, index, _cuts(parts.mapInArrow(score, "lang string, toxic long, score double")))


def train(docs: DataFrame, labels: DataFrame, bound: int = DRIVER_ROWS) -> Classifier:
    """A network for each fold of the labelled rows, fitted on the other folds; the thresholds are found on all rows, each scored by the network that did not see it.

    Their mean is the score, so what is calibrated is what scores. Where the folds have no toxic rows to spare, one network is fitted on all
    rows and nothing is calibrated. More rows of a label than bound are learned in parts, by tasks: none is left out.
    """
    rows = sample(docs, labels, bound)
    if rows is None:
        return _train_in_parts(docs, labels)
    each = [np.array(s, np.int32) for s in rows["slots"]]
    label = np.array(rows["toxic"], np.float32)
    lang = np.array([x or "" for x in rows["lang"]])
    seen = np.zeros(SPACE, np.int32)
    for s in each:
        seen[np.unique(s)] += 1
    known = np.flatnonzero(seen >= MIN_TEXTS)
    index = np.zeros(SPACE, np.int32)
    index[known[known > 0]] = np.arange(1, 1 + (known > 0).sum())
    texts, size = [index[s] for s in each], int((known > 0).sum()) + 1
    fold = np.array([_fold(i) for i in rows["doc_id"]], np.int64)
    if not all(label[fold != k].any() and (fold == k).any() for k in range(FOLDS)):
        return Classifier([fit(texts, label, size)], index, {})
    nets, score = [], np.zeros(len(texts))
    for k in range(FOLDS):
        nets.append(fit([t for t, f in zip(texts, fold) if f != k], label[fold != k], size))
        score[fold == k] = nets[-1].forward([t for t, f in zip(texts, fold) if f == k])
    return Classifier(nets, index, _calibrated(score, label, lang))


def score_toxicity(docs: DataFrame, labels: DataFrame, bound: int = DRIVER_ROWS, model: Classifier | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (score >= 0.3), threshold, toxic.

    Trained on the labels (doc_id, toxic) of rows that are not held out: those whose crc32(doc_id as text) mod 4 is not 2;
    all of them. Label, language, source and doc_id are no inputs of the score. threshold is that of the
    row's language where calibration had enough positives, else the one that other languages share, 0.3 without calibration; toxic tells whether the score reaches it. A null or
    empty text scores as padding alone; texts are read whole; repeated rows score alike; without any labelled row the
    scores are those of an untrained network. An empty table gives no rows. Other columns are ignored.
    """
    spark = session_of(docs)
    ship_code(spark)
    found = model or train(docs, labels, bound)
    shared = spark.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lorespark.llm.common import only

        only("toxicity")
        use = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(use.score(batch.column(1).to_pylist()))], ["doc_id", "lang", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    scored = docs.select("doc_id", text_of().cast("binary").alias("text"), lang.alias("lang")).mapInArrow(run, f"doc_id {kind}, lang string, score double")
    threshold = F.lit(found.threshold(OTHERS))
    for name, value in found.thresholds.items():
        if name is not OTHERS:
            threshold = F.when(F.col("lang") == name, F.lit(value)).otherwise(threshold)
    scored = scored.withColumn("threshold", threshold)
    return scored.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("toxic")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, bound: int = DRIVER_ROWS, model: Classifier | None = None) -> DataFrame:
    """The rows of docs, with all their columns, whatever their names, that are not scored as toxic for their language.

    A null or empty text scores as padding alone, a null lang has the shared threshold, a score at the threshold goes. Repeated
    rows go or stay alike; texts are read whole; an empty table gives no rows. Rows stay where they are: nothing is shuffled.
    """
    spark = session_of(docs)
    ship_code(spark)
    found = model or train(docs, labels, bound)
    shared, columns = spark.sparkContext.broadcast(found), docs.columns
    at, lang = columns.index("text"), columns.index("lang") if "lang" in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lorespark.llm.common import only

        only("toxicity")
        use = shared.value
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(at).to_pylist()]
            limits = [use.threshold(x) for x in batch.column(lang).to_pylist()] if lang is not None else [use.threshold(OTHERS)] * len(texts)
            yield batch.filter(pa.array(use.score(texts) < np.array(limits)))

    return docs.mapInArrow(run, docs.schema)

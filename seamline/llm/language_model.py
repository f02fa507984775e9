"""Language-model scoring by a log-bilinear model trained with noise-contrastive estimation (operator 12).

Tokens of a text are its words (A-Z lower-cased, cut at white space) and one end.

1. Word counts over all training documents: each task counts its own words, a row a task
   and word is shuffled. N tokens, V distinct ones, end included.
2. The most frequent words, `frequent` at most, travel to the tasks; the `outputs` most frequent of
   them, and the end, are outputs of their own, the others share an output with those of
   about their count (powers of two), and all other words, unknown ones too, share one, the tail.
   Texts become arrays of output numbers; words of the tail stay beside them as words, and
   find their counts by a join.
3. The model gives each output w after the outputs u, v the score
   (R[u] * c1 + R[v] * c2) . Q[w] + b[w]. It is trained on every training document in `rounds`
   rounds: in a round each task runs noise-contrastive estimation in numpy over its own
   documents of that round, from the same parameters, and the results are averaged, weighted
   by tokens. b starts at the logarithm of the counts' shares, which are the noise, too.
4. Log-probabilities are normalised over all outputs, by matrix products over batches
   of distinct contexts. Within a shared output a word has probability (c + 1) / (sum of c + 1
   over its words; in the tail, one unknown word counts as a word of c = 0). So the
   probabilities of all words, end and the unknown word sum to 1.

The base score is that of single words: log10((c + 1) / (N + V + 1)) summed over the tokens.

Null and empty texts have the end as their only token. A null id counts as an empty one, which
trains. Rows are kept one for one, repeated rows and ids included: a repeated document
trains as often as it is there. Without training documents, N and V are 0 and every
word is unknown. An empty table gives an empty result; columns beyond id and text are
ignored, whatever their names. Texts and words may be of any length.

The same table in the same partitions gives the same figures: tasks' parameters are added as
integers (2^-16), so the order of addition doesn't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm.shared import table, written

#: Parameters are added in units of 1 / SCALE, in pieces of PIECE.
SCALE, PIECE = 1 << 16, 4096


def tokens(text: str | None) -> list[bytes]:
    """Words of a text; bytes.lower() is for A-Z only, bytes.split() at \\x20 and \\x09-\\x0D only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def held_out(key: Column, parts: int = 7, part: int = 2) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % parts == part


def word_counts(docs: DataFrame, most: int = 1 << 20) -> DataFrame:
    """word, c: counts over docs (text); the empty word is the end, which counts documents. A task gives its counts
    away whenever it holds `most` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(tokens(text))
                counts[b""] += 1
                if len(counts) >= most:
                    yield flush()
        if counts:
            yield flush()

    return docs.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Vocabulary:
    """Frequent words and their outputs. number: word to its place in counts and output;
    totals: per output the sum of c + 1 of its words; tail_total: that of the tail."""

    n_tokens: int
    n_words: int
    number: dict[bytes, int]
    counts: np.ndarray
    output: np.ndarray
    n_outputs: int
    totals: np.ndarray
    tail_total: float
    #: counts of outputs, for noise and first biases
    seen: np.ndarray = field(repr=False, default=None)

    @property
    def tail(self) -> int:
        return self.n_outputs - 1

    @classmethod
    def of(cls, counted: DataFrame, outputs: int, frequent: int) -> Vocabulary:
        """From word_counts; words come to the driver from the least count on (of sixteen in
        each power of two) that no more than `frequent` of them reach."""
        total = counted.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.col("c") + 1).alias("smooth")).first()
        n_tokens, n_words, smooth = total["n"] or 0, total["v"], total["smooth"] or 0
        step, words_only = F.floor(F.log2("c") * 16).cast("int"), counted.where("length(word) > 0")
        reach, least = 0, None
        for r in words_only.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
            reach += r["count"]
            if reach > frequent:
                break
            least = r["step"]
        top = sorted(((bytes(r["word"]), r["c"]) for r in words_only.where(step >= least).collect()), key=lambda x: (-x[1], x[0])) if least is not None else []
        ends = counted.where("length(word) = 0").first()
        words = [(b"", ends["c"] if ends else 0), *top]
        counts = np.array([c for _, c in words], np.int64)
        own = min(outputs, len(top)) + 1
        output = np.arange(len(words))
        kinds = np.floor(np.log2(counts[own:] + 1)).astype(int)
        for k, kind in enumerate(sorted(set(kinds.tolist()), reverse=True)):
            output[own:][kinds == kind] = own + k
        n_outputs = own + len(set(kinds.tolist())) + 1
        smoothed = np.bincount(output, counts + 1.0, n_outputs)
        tail_total = smooth - float((counts + 1).sum()) + 1 + (0 if ends else 1)
        seen = np.bincount(output, counts.astype(float), n_outputs)
        seen[-1] = n_tokens - seen.sum()
        return cls(n_tokens, n_words, {w: i for i, (w, _) in enumerate(words)}, counts, output, n_outputs, smoothed, tail_total, seen)

    def within(self) -> np.ndarray:
        """log10 of each frequent word's share in its output."""
        own = np.bincount(self.output, minlength=self.n_outputs) == 1
        return np.where(own[self.output], 0.0, np.log10((self.counts + 1) / self.totals[self.output]))


def encoded(docs: DataFrame, v: Vocabulary, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, ids (outputs, 16 bits each), and of the frequent words: n_known,
    base and share (log10 sums); words outside them as tail (word, n)."""
    logs = np.log10((v.counts + 1) / (v.n_tokens + v.n_words + 1))
    shares, outs, known = v.within(), v.output.astype("<u2"), v.counts > 0
    number, tail = v.number, v.tail

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = number.get
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                rows, last, times, ends = [], [], [], [0]
                for text in part.column("text").to_pylist():
                    words = tokens(text)
                    words.append(b"")
                    at = np.array([get(w, -1) for w in words])
                    there = at[at >= 0]
                    rest = Counter(words[i] for i in np.flatnonzero(at < 0))
                    ids = np.where(at >= 0, outs[at], tail).astype("<u2")
                    rows.append((len(words), int(known[there].sum()), float(logs[there].sum()), float(shares[there].sum()), ids.tobytes()))
                    last.extend(rest)
                    times.extend(rest.values())
                    ends.append(len(last))
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
                words_of = pa.StructArray.from_arrays([pa.array(last, pa.binary()), pa.array(times, pa.int64())], ["word", "n"])
                columns = [part.column("doc_id"), part.column("held_out"), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words_of)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base", "share", "ids", "tail"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("doc_id"), held_out(F.col(id_column)).alias("held_out"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, share double, ids binary, tail array<struct<word:binary,n:bigint>>").withColumn("row", F.monotonically_increasing_id())


@dataclass
class Model:
    """Parameters of the log-bilinear model; the last row of R stands for what precedes a text."""

    R: np.ndarray
    Q: np.ndarray
    C: np.ndarray
    b: np.ndarray

    @classmethod
    def first(cls, seen: np.ndarray, size: int, seed: int = 42) -> Model:
        rng, n = np.random.default_rng(seed), len(seen)
        f = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        return cls(f(n + 1, size), f(n, size), np.ones((2, size), np.float32), np.log((seen + 1) / (seen.sum() + n)).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.R, self.Q, self.C, self.b)])

    def filled(self, values: np.ndarray) -> Model:
        out, at = [], 0
        for x in (self.R, self.Q, self.C, self.b):
            out.append(values[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Model(*out)

    def log10(self, ids: np.ndarray, before: np.ndarray, batch: int = 4096) -> np.ndarray:
        """Normalised log10 probability of each output after its two before it, by matrix
        products over batches of distinct contexts."""
        n = len(self.R)
        key = before[:, 0] * n + before[:, 1]
        there = np.zeros(n * n, bool)
        there[key] = True
        keys = np.flatnonzero(there)
        place = np.empty(n * n, np.int32)
        place[keys] = np.arange(len(keys))
        of = place[key]
        order = np.argsort(of, kind="stable")
        upto = np.searchsorted(of[order], np.arange(len(keys) + 1))
        out = np.empty(len(ids), np.float32)
        for a in range(0, len(keys), batch):
            k = keys[a : a + batch]
            scores = (self.R[k // n] * self.C[0] + self.R[k % n] * self.C[1]) @ self.Q.T + self.b
            top = scores.max(axis=1)
            norm = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
            at = order[upto[a] : upto[min(a + batch, len(keys))]]
            out[at] = scores[of[at] - a, ids[at]] - norm[of[at] - a]
        return out * np.float32(1 / np.log(10))


def contexts(ids: list[np.ndarray], start: int) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of some texts, and the two before each (start before a text's first)."""
    flat = np.concatenate(ids).astype(np.int32)
    before = np.empty((len(flat), 2), np.int32)
    before[2:, 0], before[1:, 1] = flat[:-2], flat[:-1]
    first = np.append(0, np.cumsum([len(x) for x in ids]))[:-1]
    before[first] = start
    second = first[np.array([len(x) for x in ids]) > 1] + 1
    before[second, 0] = start
    return flat, before


def added(into: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The places in `into` that occur in at, after adding the sums of their rows (a gradient); returns these places."""
    order = np.argsort(at, kind="stable")
    places, first = np.unique(at[order], return_index=True)
    into[places] = np.add.reduceat(rows[order], first, axis=0)
    return places


class Trainer:
    """Noise-contrastive estimation by minibatches, with Adagrad. Each batch draws `noise`
    outputs from the counts' shares, shared by its tokens; scores count as
    log-probabilities without normalising them."""

    def __init__(self, model: Model, seen: np.ndarray, seed: int, noise: int = 64, rate: float = 0.1) -> None:
        self.m = Model(*(x.copy() for x in (model.R, model.Q, model.C, model.b)))
        self.share = (seen + 1) / (seen + 1).sum()
        self.upto, self.log_noise = np.cumsum(self.share), np.log(noise * self.share).astype(np.float32)
        self.rng, self.noise, self.rate = np.random.default_rng(seed), noise, rate
        self.squares = Model(*(np.full_like(x, 1e-2) for x in (model.R, model.Q, model.C, model.b)))
        self.sums = Model(*(np.zeros_like(x) for x in (model.R, model.Q, model.C, model.b)))

    def step(self, ids: np.ndarray, before: np.ndarray) -> None:
        m, n = self.m, len(ids)
        u, v = m.R[before[:, 0]], m.R[before[:, 1]]
        h = u * m.C[0] + v * m.C[1]
        drawn = np.minimum(np.searchsorted(self.upto, self.rng.random(self.noise)), len(self.upto) - 1)
        q, qn = m.Q[ids], m.Q[drawn]
        # distance of the model's log-odds from 1 for data, from 0 for noise
        gd = 1 / (1 + np.exp(-((h * q).sum(axis=1) + m.b[ids] - self.log_noise[ids]))) - 1
        gn = 1 / (1 + np.exp(-(h @ qn.T + m.b[drawn] - self.log_noise[drawn])))
        gh = gd[:, None] * q + gn @ qn
        at = np.concatenate([ids, drawn])
        rows = np.concatenate([np.column_stack([gd[:, None] * h, gd]), np.column_stack([gn.T @ h, gn.sum(axis=0)])])
        both = np.zeros((len(m.Q), rows.shape[1]), np.float32)
        places = added(both, at, rows)
        self.move("Q", places, both[places, :-1] / n)
        self.move("b", places, both[places, -1] / n)
        r = np.zeros_like(m.R)
        places = added(r, np.concatenate([before[:, 0], before[:, 1]]), np.concatenate([gh * m.C[0], gh * m.C[1]]))
        self.move("R", places, r[places] / n)
        self.move("C", np.arange(2), np.stack([(gh * u).sum(axis=0), (gh * v).sum(axis=0)]) / n)

    def move(self, name: str, places: np.ndarray, gradient: np.ndarray) -> None:
        squares, x = getattr(self.squares, name), getattr(self.m, name)
        # gradients are means over the batch; in Adagrad only their proportions count
        g = gradient * 100
        squares[places] += g * g
        x[places] -= self.rate * g / np.sqrt(squares[places])


def tokens_in_parts(batches: Iterator[pa.RecordBatch], most: int = 1 << 18) -> Iterator[list[np.ndarray]]:
    """Ids of texts, in groups of about `most` tokens."""
    for batch in batches:
        ids, size = [], 0
        for x in batch.column("ids").to_pylist():
            ids.append(np.frombuffer(x, "<u2"))
            size += len(ids[-1])
            if size >= most:
                yield ids
                ids, size = [], 0
        if ids:
            yield ids


def trained(rows: DataFrame, v: Vocabulary, size: int = 32, rounds: int = 4, batch: int = 1024, groups: int = 64) -> Model:
    """The model after `rounds` rounds over all training rows, each row in one of them."""
    model = Model.first(v.seen, size)
    training = rows.where("not held_out").select("ids", F.pmod(F.xxhash64("row"), F.lit(rounds)).alias("round"))
    length = model.flat().size
    for k in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], model: Model = model, k: int = k) -> Iterator[pa.RecordBatch]:
            trainer, n, start = None, 0, len(model.Q)
            for ids in tokens_in_parts(batches):
                flat, before = contexts(ids, start)
                # the task's own draws follow from its first tokens, so a task that runs again does the same
                trainer = trainer or Trainer(model, v.seen, seed=[k, *flat[:64].tolist()], rate=0.1 / (k + 1) ** 0.5)
                order = trainer.rng.permutation(len(flat))
                for a in range(0, len(flat), batch):
                    at = order[a : a + batch]
                    trainer.step(flat[at], before[at])
                n += len(flat)
            if n:
                n = min(n, 1 << 22)
                values = np.rint(trainer.m.flat().astype(float) * SCALE).astype(np.int64) * n
                pieces = [values[a : a + PIECE] for a in range(0, length, PIECE)]
                part = int(trainer.rng.integers(groups))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pieces)), pa.int32()), pa.array([part] * len(pieces), pa.int32()), pa.array([n] * len(pieces), pa.int64()), pa.array(pieces, pa.list_(pa.int64()))], ["piece", "part", "n", "values"])

        kinds = "piece int, part int, n bigint, values array<bigint>"
        out = training.where(F.col("round") == k).select("ids").mapInArrow(run, kinds)
        for keys in (("piece", "part"), ("piece",)):
            out = out.repartition(*keys).mapInArrow(summed, kinds)
        total: dict[int, tuple[int, np.ndarray]] = {}
        for r in out.collect():  # a row a piece
            n, values = total.get(r["piece"], (0, 0))
            total[r["piece"]] = n + r["n"], values + np.array(r["values"], np.int64)
        if total:
            model = model.filled(np.concatenate([total[p][1] / (total[p][0] * SCALE) for p in sorted(total)]))
    return model


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows added by (piece, part); rows stream through, sums stay."""
    total: dict[tuple[int, int], list] = {}
    for batch in batches:
        for piece, part, n, values in zip(*(batch.column(c).to_pylist() for c in ("piece", "part", "n")), batch.column("values")):
            got = total.setdefault((piece, part), [0, 0])
            got[0] += n
            got[1] = got[1] + values.values.to_numpy()
    if total:
        columns = zip(*((p, q % 8, n, values) for (p, q), (n, values) in total.items()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], ["piece", "part", "n", "values"])


def model_scores(rows: DataFrame, model: Model) -> DataFrame:
    """row and outputs: the log10 probability of a text's outputs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for ids in tokens_in_parts([batch], 1 << 21):
                flat, before = contexts(ids, len(model.Q))
                upto = np.append(0, np.cumsum(model.log10(flat, before).astype(float)))
                ends = np.append(0, np.cumsum([len(x) for x in ids]))
                sums.append(upto[ends[1:]] - upto[ends[:-1]])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.concatenate(sums) if sums else [], pa.float64())], ["row", "outputs"])

    return rows.select("row", "ids").mapInArrow(run, "row bigint, outputs double")


def scored(docs: DataFrame, outputs: int = 1000, frequent: int = 1 << 16, size: int = 32, rounds: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    outputs: words with an output of their own; frequent: words that are sent to tasks;
    size: numbers of a word's representation; rounds: averagings over one pass through
    the training documents."""
    kept = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    counted = written(word_counts(kept.where(~held_out(F.col("doc_id"))).select("text")), "word-counts")
    v = Vocabulary.of(counted, outputs, frequent)
    rows = written(encoded(kept, v), "encoded-texts")
    model = trained(rows, v, size, rounds)
    # words outside the frequent ones: each is in fewer than one in `frequent` training tokens
    tails = rows.select("row", F.explode("tail").alias("t")).select("row", "t.*")
    with_counts = tails.join(counted, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    whole = float(v.n_tokens + v.n_words + 1)
    sums = with_counts.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tail_known"),
        F.sum(F.col("n") * F.log10((F.col("c") + 1) / F.lit(whole))).alias("tail_base"),
        F.sum(F.col("n") * F.log10((F.col("c") + 1) / F.lit(v.tail_total))).alias("tail_share"),
    )
    of = model_scores(rows, model)
    joined = rows.drop("ids", "tail").join(of, "row").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("tail_known")).alias("n_known"), F.lit(v.n_tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + zero("tail_base")).alias("base_score"), (F.col("outputs") + F.col("share") + zero("tail_share")).alias("score"),
    )


def op12_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))


QUERIES = {"op12_language_model": op12_language_model}
#: Training is beyond SQL; tests hold counts and base scores against brute force, and the model against the base.
ORACLE_SQL: dict[str, str] = {}

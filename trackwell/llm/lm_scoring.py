"""Language-model scores: corpus word counts, and a gated recurrent network with a class-factored output."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackwell.llm.common import Scratch, free_name

#: Words with an output of their own, in classes of CLASS_WORDS by frequency; all other words share the rare classes.
CLASS_WORDS = 32
CLASSES = 32
HIDDEN = 24
#: Words whose counts are broadcast for a look-up in the map (16 bytes each); all others are joined.
KNOWN_WORDS = 262_144
#: The end of a document, counted as a token; no word holds a line feed.
END = xxhash.xxh64_intdigest(b"\n", 3)
#: Rare words are told apart by form: plain, with characters beyond ASCII, with digits or marks.
FORMS = 3
WINDOW = 32
#: Tokens after which training, but never scoring, begins with a fresh state, so that long texts can be learned side by side.
SEGMENT = 256
#: Parts of one in which the weights' steps are averaged, and how many of them travel as one row.
UNIT, PART = 1 << 16, 1 << 10
SMOOTH = 0.1
SEED = 17
#: Bytes of documents that are split into words at a time, documents that the network reads side by side, tokens of them, the padding included, and
#: tokens whose outputs are worked out together.
PIECE = 12_000_000
WIDTH = 1_024
AREA = 1 << 21
TOGETHER = 8_192
#: The share of the learning rows that the network's weights are fitted on, and the rows, about, of which a task learns in a round.
SHARE, TASK_ROWS = 1.0, 500
#: Rows, about, that a task scores where there are more such tasks than cores: like lengths go side by side, so that more rows mean fuller arrays.
SCORED_ROWS = 8_000
#: Sequences of up to SEGMENT tokens that learn side by side, a window a step.
BESIDE = 64


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Array]]:
    """The documents' texts, PIECE bytes at a time, one document at least: (number of the first document, texts)."""
    texts = batch.column("text")
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, before + PIECE, side="right")))
        yield first, texts.slice(first, stop - first)
        first = stop


@dataclass
class _Tokens:
    """Of some documents: each token's document and word, its end being the last; and of the words hash and form."""

    doc: np.ndarray
    word: np.ndarray
    hashes: np.ndarray
    forms: np.ndarray


def _tokens(texts: pa.Array) -> _Tokens:
    """Lower-cased words between white space, and an end for each document, the last of the words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0)  # white space at either end gives an empty word
    ends = np.cumsum(pc.list_value_length(lists).to_numpy())
    empty = np.flatnonzero(~real.to_numpy(zero_copy_only=False))
    n = np.diff(ends, prepend=0) - np.bincount(np.searchsorted(ends, empty, side="right"), minlength=len(texts))
    coded = (flat.filter(real) if len(empty) else flat).dictionary_encode()
    words = coded.dictionary
    marked = pc.match_substring_regex(pc.ascii_rtrim(words, characters=".,"), r"[\x00-\x40\x5b-\x60\x7b-\x7f]")
    forms = np.where(marked, 2, pc.invert(pc.string_is_ascii(words)))
    as_bytes = words.cast(pa.large_binary() if pa.types.is_large_string(words.type) else pa.binary()).to_numpy(zero_copy_only=False)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 3) for w in as_bytes), np.uint64, len(words))
    return _Tokens(
        np.repeat(np.arange(len(texts)), n + 1), np.insert(coded.indices.to_numpy().astype(np.int64), np.cumsum(n), len(words)),
        np.append(hashes, np.uint64(END)), np.append(forms, 0).astype(np.int64),
    )


def count_words(docs: DataFrame) -> DataFrame:
    """docs(text) -> (word: 64-bit hash as long, form, n): every word of every row, and an end for each row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _pieces(batch):
                found = _tokens(texts)
                n = np.bincount(found.word, minlength=len(found.hashes))
                yield pa.RecordBatch.from_arrays([pa.array(found.hashes.view(np.int64)), pa.array(found.forms.astype(np.int32)), pa.array(n)], ["word", "form", "n"])

    found = docs.select("text").mapInArrow(count, "word long, form int, n long")
    return found.groupBy("word").agg(F.max("form").alias("form"), F.sum("n").alias("n"))


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of counts above the least count, in eighths of an octave, that at most `most` rows reach.

    Only the number of words at each of some 500 steps goes to the driver, whatever the
    input; a global sort with a limit would send `most` rows from every partition. Counts of
    one step come or stay out together.
    """
    step = F.floor(F.log2("n") * 8)
    reached, least = 0, None
    for row in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("k")).collect(), reverse=True):
        reached += row["k"]
        if reached > most:
            break
        least = row["step"]
    return counts.where(F.lit(False) if least is None else step >= F.lit(least))


@dataclass
class Vocabulary:
    """hashes: sorted, of the words with an output; ids: their numbers by falling frequency."""

    hashes: np.ndarray
    ids: np.ndarray
    size: int

    @property
    def inputs(self) -> int:
        return self.size + FORMS

    def number(self, hashes: np.ndarray, forms: np.ndarray) -> np.ndarray:
        """Each word's id, or size + form for a rare one."""
        if not self.size:
            return forms.astype(np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), self.size - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], self.size + forms)


def _log_softmax(logit: np.ndarray, y: np.ndarray, gradient: bool) -> np.ndarray:
    """log p(y) for logits (outputs, rows) in one piece, each row a column; with gradient, the logits become its gradient by them."""
    chosen, most = y * len(y) + np.arange(len(y)), logit.max(axis=0)
    if len(y) and max(most.max(), -most.min()) > 40:  # else exp neither overflows nor vanishes
        logit -= most
    out = logit.reshape(-1)[chosen]
    np.exp(logit, out=logit)
    norm = logit.sum(axis=0)
    out -= np.log(norm)
    if gradient:
        logit *= -1 / norm
        logit.reshape(-1)[chosen] += 1
    return out


class RecurrentModel:
    """A GRU over words; log p(word) = log p(class | state) + log p(word | class, state). A rare form is a class of its own.

    All arrays are in `p`: e (input embeddings already multiplied by the input weights), u and
    uh (state to gates and candidate), b, c and cb (class outputs), w and wb (word outputs).
    """

    def __init__(self, vocabulary: Vocabulary, frequency: np.ndarray | None = None, seed: int = SEED):
        self.v, h = vocabulary, HIDDEN
        self.full = -(-vocabulary.size // CLASS_WORDS)
        self.classes = self.full + FORMS
        self.class_by_id = np.append(np.arange(vocabulary.size) // CLASS_WORDS, self.full + np.arange(FORMS)).astype(np.int16)
        rng = np.random.default_rng(seed)
        f = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        zeros = lambda *s: np.zeros(s, np.float32)
        self.p = {
            "e": (rng.normal(size=(vocabulary.inputs, 3 * h)) * 0.3).astype(np.float32), "u": f(h, 2 * h), "uh": f(h, h), "b": zeros(3 * h),
            "c": f(h, self.classes) * 0.1, "cb": zeros(self.classes), "w": f(h, self.full * CLASS_WORDS) * 0.1, "wb": zeros(self.full * CLASS_WORDS),
        }
        self.p["b"][: h] = 1.0  # at first the state changes slowly
        if frequency is not None:
            share = np.log((frequency + SMOOTH) / (frequency.sum() + SMOOTH * len(frequency)))
            words = np.full(self.full * CLASS_WORDS, -30.0)
            words[: vocabulary.size] = share[: vocabulary.size]
            self.p["wb"][:] = words
            grouped = np.exp(words.reshape(self.full, CLASS_WORDS)).sum(axis=1)
            self.p["cb"][:] = np.log(np.append(grouped, np.exp(share[vocabulary.size :])))
        elif self.full * CLASS_WORDS > vocabulary.size:
            self.p["wb"][vocabulary.size :] = -30.0

    def states(self, x: np.ndarray, h: np.ndarray, keep: bool = False):
        """x (steps, docs) of inputs, h (docs, HIDDEN) carried in -> states after each step; with keep, also (states before each, gates and candidates).

        Reset gate, update gate and candidate of a step follow each other, (steps, 3, docs, HIDDEN), so that what is worked out for a step lies in one piece.
        Gates are 1 / (1 + exp(-a)), whose exp may overflow: then they are 0, as they should be.
        """
        n, u, uh, b = HIDDEN, self.p["u"], self.p["uh"], self.p["b"]
        minus_u = -np.stack([u[:, n:], u[:, :n]])
        inputs = np.empty_like(self.p["e"])
        np.subtract(-b[: 2 * n], self.p["e"][:, : 2 * n], out=inputs[:, : 2 * n])
        np.add(self.p["e"][:, 2 * n :], b[2 * n :], out=inputs[:, 2 * n :])
        rzk = inputs.reshape(-1, n).take(x[:, None] * 3 + np.array([1, 0, 2])[:, None], axis=0)
        out = np.empty((len(x) + 1, x.shape[1], n), u.dtype)
        out[0] = h
        both, one = np.empty((2, x.shape[1], n), u.dtype), np.empty((x.shape[1], n), u.dtype)
        matmul, multiply, reciprocal, exp, tanh = np.matmul, np.multiply, np.reciprocal, np.exp, np.tanh
        h = out[0]
        with np.errstate(over="ignore"):
            for new, gates, r, z, k in zip(out[1:], rzk[:, :2], *rzk.transpose(1, 0, 2, 3)):
                matmul(h, minus_u, out=both)
                gates += both
                exp(gates, out=gates)
                gates += 1
                reciprocal(gates, out=gates)
                multiply(r, h, out=new)
                matmul(new, uh, out=one)
                k += one
                tanh(k, out=k)
                np.subtract(h, k, out=new)
                new *= z
                new += k
                h = new
        return (out[1:], (out[:-1], rzk)) if keep else out[1:]

    def class_of(self, y: np.ndarray) -> np.ndarray:
        return self.class_by_id.take(y)

    def log_probability(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None):
        """Natural log of p(y | state) for rows of h; with grads, also d(sum)/dh, and gradients are added.

        Rows are put in order by class; outputs are rows of the arrays of logits, and a bias is the weight of a one behind the state.
        """
        n, k = HIDDEN, self.class_of(y)
        order = np.argsort(k, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        k, y = k.take(order).astype(np.intp), y.take(order).astype(np.intp)
        own = np.ones((len(y), n + 1), h.dtype)
        own[:, :n] = h.take(order, axis=0)
        ends = np.searchsorted(k, np.arange(self.full + 1))
        inner = y[: ends[-1]] - k[: ends[-1]] * CLASS_WORDS
        present = [(c, slice(ends[c], ends[c + 1])) for c in range(self.full) if ends[c] < ends[c + 1]]
        outer_w = np.vstack([self.p["c"], self.p["cb"]])
        inner_w = np.vstack([self.p["w"], self.p["wb"]]).reshape(n + 1, self.full, CLASS_WORDS).transpose(1, 2, 0).copy()
        outer = outer_w.T @ own.T
        logp = _log_softmax(outer, k, grads is not None)
        if grads is not None:
            g = outer @ own
            grads["c"] += g[:, :n].T
            grads["cb"] += g[:, n]
            dh = outer.T @ outer_w[:n].T
        words = np.empty((CLASS_WORDS, len(inner)), outer.dtype)
        for c, s in present:
            np.matmul(inner_w[c], own[s].T, out=words[:, s])
        logp[: len(inner)] += _log_softmax(words, inner, grads is not None)
        out = logp.take(place)
        if grads is None:
            return out
        g = np.zeros_like(inner_w)
        back = np.empty((len(inner), n), dh.dtype)
        for c, s in present:
            np.matmul(words[:, s], own[s], out=g[c])
            np.matmul(words[:, s].T, inner_w[c, :, :n], out=back[s])
        g = g.reshape(-1, n + 1)
        grads["w"] += g[:, :n].T
        grads["wb"] += g[:, n]
        dh[: len(inner)] += back
        return out, dh.take(place, axis=0)

    def train_window(self, x: np.ndarray, y: np.ndarray, h: np.ndarray, moments: dict, rate: float):
        """One step of truncated backpropagation through a window; -> (log p, tokens, state carried out). y < 0: no token."""
        states, (before, rzk) = self.states(x, h, keep=True)
        real = y >= 0
        grads = {n: np.zeros_like(self.p[n]) for n in ("c", "cb", "w", "wb")}
        n, (r, z, k) = HIDDEN, rzk.transpose(1, 0, 2, 3)
        if real.all():
            logp, d = self.log_probability(states.reshape(-1, n), y.ravel(), grads)
            d = d.reshape(states.shape)
        else:
            logp, dreal = self.log_probability(states[real], y[real], grads)
            d = np.zeros_like(states)
            d[real] = dreal
        u = np.stack([self.p["u"][:, n:].T, self.p["u"][:, :n].T])
        uh = self.p["uh"].T
        kept, inner = 1 - z, r * before
        drzk = np.empty_like(rzk)  # at first what the gradients of gates and candidate are multiplied by, then, step by step, these
        dr, dz, dk = drzk.transpose(1, 0, 2, 3)
        np.multiply(k, k, out=dk)
        np.subtract(1, dk, out=dk)
        dk *= kept
        np.subtract(before, k, out=dz)
        kept *= z
        dz *= kept
        np.subtract(1, r, out=dr)
        dr *= inner
        drh, both = np.empty_like(before[0]), np.empty_like(rzk[0, :2])
        back, (by_r, by_z) = np.zeros_like(before[0]), both
        matmul, multiply = np.matmul, np.multiply
        steps = (d, dr, dk, drzk[:, 1:], drzk[:, :2], z, r)
        for d_t, dr_t, dk_t, dzk_t, drz_t, z_t, r_t in zip(*(a[::-1] for a in steps)):
            back += d_t
            multiply(back, dzk_t, out=dzk_t)
            matmul(dk_t, uh, out=drh)
            multiply(drh, dr_t, out=dr_t)
            matmul(drz_t, u, out=both)
            back *= z_t
            drh *= r_t
            back += drh
            back += by_r
            back += by_z
        rows = lambda a: a.reshape(-1, n)
        times = np.bincount(x.ravel())
        used = np.flatnonzero(times)
        first = np.cumsum(times[used]) - times[used]
        order = np.argsort(x.ravel().astype(np.int16), kind="stable")
        at = np.add.outer(np.arange(len(x)) * 3 * x.shape[1], np.arange(x.shape[1])).ravel().take(order)  # of each token's reset gate
        flat = rows(drzk).take(at[:, None] + np.array([1, 0, 2]) * x.shape[1], axis=0).reshape(-1, 3 * n)
        grads["uh"] = rows(inner).T @ rows(dk)
        grads["u"] = rows(before).take(order, axis=0).T @ flat[:, : 2 * n]
        grads["b"] = np.ones(len(flat), flat.dtype) @ flat
        pairs = flat.view(np.result_type(flat, np.complex64))  # two numbers at a time: half as many sums to begin
        grads["e"] = np.add.reduceat(pairs, first, axis=0).view(flat.dtype)
        scale = 1 / max(1, int(real.sum()))
        for name, g in grads.items():
            size = g * g
            if name in moments:
                moments[name] *= 0.99
                size *= 0.01 * scale**2
            else:
                moments[name] = np.zeros_like(self.p[name])
                size *= scale**2
            g *= rate * scale
            if name == "e":  # the other inputs' embeddings have no gradient
                size += moments[name][used]
                moments[name][used] = size
                np.sqrt(size, out=size)
            else:
                moments[name] += size
                np.sqrt(moments[name], out=size)
            size += 1e-5
            g /= size
            if name == "e":
                self.p[name][used] += g
            else:
                self.p[name] += g
        return float(logp.sum()), int(real.sum()), states[-1]


def _lockstep(ids: list[np.ndarray], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sequences of like length side by side: (their numbers, lengths rising, tokens (steps, sequences), -1 beyond the end).

    At most `width` at a time, and fewer of long ones, so that no array holds more than AREA tokens or one sequence.
    """
    order, at = sorted(range(len(ids)), key=lambda i: len(ids[i])), 0
    while at < len(order):
        stop = at + 1
        while stop < min(len(order), at + width) and len(ids[order[stop]]) * (stop + 1 - at) <= AREA:
            stop += 1
        own, at = order[at:stop], stop
        y = np.full((len(ids[own[-1]]), len(own)), -1, np.int64)
        for j, i in enumerate(own):
            y[: len(ids[i]), j] = ids[i]
        yield np.array(own), np.array([len(ids[i]) for i in own]), y


def _document_scores(model: "RecurrentModel", ids: list[np.ndarray], end: int) -> np.ndarray:
    """log10 p of each document's ids that have an output or a rare class, the state carried from window to window."""
    out = np.zeros(len(ids))
    for own, length, y in _lockstep(ids, WIDTH):
        h = np.zeros((len(own), HIDDEN), np.float32)
        for t in range(0, len(y), WINDOW):
            live = int(np.searchsorted(length, t, side="right"))  # shorter documents have ended
            part = y[t : t + WINDOW, live:]
            x = np.empty_like(part)
            x[0] = np.maximum(y[t - 1, live:], 0) if t else end
            np.maximum(part[:-1], 0, out=x[1:])
            states = model.states(x, h[live:])
            h[live:] = states[-1]
            real = part >= 0
            own_states, own_y = (states.reshape(-1, HIDDEN), part.ravel()) if real.all() else (states[real], part[real])
            logp = np.zeros(part.shape)
            logp[real] = np.concatenate([model.log_probability(own_states[i : i + TOGETHER], own_y[i : i + TOGETHER]) for i in range(0, len(own_y), TOGETHER)]) / np.log(10)
            out[own[live:]] += logp.sum(axis=0)
    return out


def _model_ids(found: _Tokens, docs: int, vocabulary: Vocabulary) -> tuple[np.ndarray, pa.Array]:
    """The model's id of each word; and of each document those of its tokens, as 16-bit numbers end to end."""
    ids = vocabulary.number(found.hashes, found.forms)
    ends = np.append(0, np.cumsum(np.bincount(found.doc, minlength=docs))) * 2
    flat = ids[found.word].astype(np.int16)
    return ids, pa.Array.from_buffers(pa.large_binary(), docs, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())


def _ids_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.int16) for x in batch.column("ids")]


def _numbered(lessons: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """lessons(doc_id, text, round) -> (doc_id, ids, round), ids being the model's, of every word and the end."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _pieces(batch):
                own = batch.slice(first, len(texts))
                ids = _model_ids(_tokens(texts), len(texts), vocabulary)[1]
                yield pa.RecordBatch.from_arrays([own.column("doc_id").cast(pa.int64()), ids, own.column("round")], ["doc_id", "ids", "round"])

    return lessons.select("doc_id", "text", F.col("round").cast("int")).mapInArrow(number, "doc_id long, ids binary, round int")


def rounds_of(rows: int) -> tuple[int, int]:
    """(rounds, tasks of each) for a number of rows: rounds grow with the cube root of the tasks' number, so both the length of the way and its width do."""
    blocks = max(1, rows // TASK_ROWS)
    rounds = 1 + math.ceil(blocks ** (1 / 3))
    return rounds, -(-blocks // rounds)


def _add_up(rows: pa.Table) -> pa.Table:
    """The sums, by tokens, of one part of the tasks' steps: PART numbers a task."""
    tokens, total = rows["tokens"].to_numpy(), 0
    for k in range(0, len(rows), 1024):
        moved = np.stack(rows["moved"].slice(k, 1024).to_numpy()).astype(np.int64)
        total = total + tokens[k : k + 1024] @ moved
    return pa.table({"part": rows["part"][:1].cast(pa.int32()), "tokens": pa.array([int(tokens.sum())], pa.int64()), "moved": pa.array([total], pa.list_(pa.int64()))})


def train(lessons: DataFrame, vocabulary: Vocabulary, frequency: np.ndarray, rounds: int, tasks: int, rate: float = 0.02, seed: int = SEED) -> RecurrentModel:
    """Truncated backpropagation in rounds over rows of their own: in each, tasks go on from the last average, and their weights are averaged by tokens.

    lessons(doc_id, text, round) should be the rows to learn from, dealt over rounds, with the model's ids instead of texts where those are known; each
    task sees its share whole, in an order fixed by id and tokens. How far each task's weights have moved is added up in Spark, as whole multiples of 1 / UNIT so that the
    order doesn't matter and reruns agree; the driver gets one model's arrays, bounded by the vocabulary. Null and blank texts teach their end. Without rows the weights stay as they began.
    """
    model = RecurrentModel(vocabulary, frequency, seed)
    if not vocabulary.size:
        return model
    if "ids" not in lessons.columns:
        lessons = _numbered(lessons, vocabulary)
    end = vocabulary.number(np.array([END], np.uint64), np.zeros(1, np.int64))[0].astype(np.int16)
    for n in range(rounds):
        start, step = model.p, rate / (1 + n) ** 0.5
        own_hash = F.xxhash64("doc_id", "ids")
        shares = lessons.where(F.col("round") == n).select("doc_id", "ids").repartition(tasks, own_hash).sortWithinPartitions(own_hash, "doc_id", "ids").select("ids")

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = RecurrentModel(vocabulary, None, seed)
            own.p = {k: a.copy() for k, a in start.items()}
            moments: dict = {}
            tokens = 0
            for batch in batches:
                pairs = [np.stack([np.append(end, d[:-1]), d]) for d in _ids_of(batch)]
                parts = [p[:, i : i + SEGMENT] for p in pairs for i in range(0, p.shape[1], SEGMENT)]
                for chosen, _, y in _lockstep([p[1] for p in parts], BESIDE):
                    x = np.zeros_like(y)
                    for j, i in enumerate(chosen):
                        x[: parts[i].shape[1], j] = parts[i][0]
                    h = np.zeros((y.shape[1], HIDDEN), np.float32)
                    for t in range(0, len(y), WINDOW):
                        _, k, h = own.train_window(x[t : t + WINDOW], y[t : t + WINDOW], h, moments, step)
                        tokens += k
            if tokens:
                moved = np.concatenate([(own.p[k] - start[k]).ravel() for k in sorted(start)])
                moved = np.rint(moved.astype(np.float64) * UNIT).astype(np.int32)
                parts = [moved[i : i + PART] for i in range(0, len(moved), PART)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(np.full(len(parts), tokens, np.int64)), pa.array(parts, pa.list_(pa.int32())),
                ], ["part", "tokens", "moved"])

        steps = shares.mapInArrow(learn, "part int, tokens long, moved array<int>")
        sums = steps.groupBy("part").applyInArrow(_add_up, "part int, tokens long, moved array<long>").toPandas().sort_values("part")
        if sums.empty:
            continue
        mean, at = (np.concatenate(list(sums["moved"])) / sums["tokens"].iloc[0] / UNIT).astype(np.float32), 0
        model.p = {}
        for k in sorted(start):
            model.p[k] = start[k] + mean[at : at + start[k].size].reshape(start[k].shape)
            at += start[k].size
    return model


def score(docs: DataFrame, learn: Column, scratch: Scratch | None = None, share: float = SHARE) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, n_known, train_tokens (longs), base_score, score (log10, doubles).

    Corpus counts cover every word of every row where `learn`, a condition on doc_id, holds.
    base_score is the add-0.1 unigram score from them. score is the network's: for each token
    the class given the state after all tokens before it, then the word given class and state;
    a rare word's share of its form comes from the corpus counts, smoothed alike. The state is
    carried through the whole document, whatever its length. The network's weights are fitted
    on all learning rows, each of them once, in rounds; the counts, on which its outputs begin, are of all rows too. With a `share` below 1, which is for
    tests, they are fitted on that share, whole texts chosen by a hash. Null and blank texts have one token, their end. Rows without an id are scored
    and not learned from. An empty table gives an empty result; with nothing to learn from all
    words are unknown.

    Counts of the most frequent words, KNOWN_WORDS at most, are looked up in the map; occurrences of
    others, added up by row and word, meet the count table in a join on the word's hash.
    """
    spark, name = docs.sparkSession, free_name(docs, "row")
    scratch = scratch or Scratch(spark, "lm")
    learned = docs.where(learn)
    counts = scratch.save(count_words(learned))
    total, types, n_docs = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == int(np.uint64(END).astype(np.int64)), F.col("n"))), F.lit(0)),
    ).first()
    top = _frequent(counts, KNOWN_WORDS).toPandas().sort_values(["n", "word"], ascending=[False, True])
    word, n = top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    size = min(len(top), CLASSES * CLASS_WORDS)
    order = np.argsort(word[:size])
    vocabulary = Vocabulary(word[:size][order], order, size)
    rare_n, rare_v = np.zeros(FORMS), np.zeros(FORMS)
    for r in counts.groupBy("form").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():
        rare_n[r["form"]], rare_v[r["form"]] = r["n"], r["k"]
    forms_of_top = top["form"].to_numpy(np.int64)[:size]
    rare_n -= np.bincount(forms_of_top, n[:size], FORMS)
    rare_v -= np.bincount(forms_of_top, minlength=FORMS)
    rounds, tasks = rounds_of(int(n_docs * share))
    picked = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    dealt = F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id", "ids"), F.lit(rounds)).cast("int")
    known = spark.sparkContext.broadcast((np.sort(word), n[np.argsort(word)]))
    rare_log = np.log10(rare_n + SMOOTH * (rare_v + 1))
    base_log = np.log10(total + SMOOTH * (types + 1))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words, known_counts = known.value
        for batch in batches:
            for first, texts in _pieces(batch):
                own, docs_here, found = batch.slice(first, len(texts)), len(texts), _tokens(texts)
                if len(known_words):
                    at = np.minimum(np.searchsorted(known_words, found.hashes), len(known_words) - 1)
                    count = np.where(known_words[at] == found.hashes, known_counts[at], 0)
                else:
                    count = np.zeros(len(found.hashes), np.int64)
                seen = count > 0
                share = np.where(seen, np.log10(count + SMOOTH), 0)
                ids, ids_of_docs = _model_ids(found, docs_here, vocabulary)
                of_form = np.where(ids >= size, share - rare_log[np.maximum(ids - size, 0)], 0)
                n = np.bincount(found.doc, minlength=docs_here)  # each has its end, and its tokens follow each other
                total_of = lambda values: np.add.reduceat(values[found.word], np.cumsum(n) - n)
                missing = ~seen[found.word]
                key, times = np.unique(found.doc[missing] * len(seen) + found.word[missing], return_counts=True)
                ends = np.searchsorted(key, np.arange(docs_here + 1) * len(seen)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    own.column("doc_id").cast(pa.int64()), own.column(name), ids_of_docs,
                    pa.ListArray.from_arrays(ends, found.hashes[key % len(seen)].view(np.int64)), pa.ListArray.from_arrays(ends, times),
                    pa.array(n), pa.array(total_of(seen.astype(np.int64))), pa.array(total_of(share) - n * base_log), pa.array(total_of(of_form)),
                ], ["doc_id", "row", "ids", "words", "times", "tokens", "known", "base", "net"])

    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias(name), "text").mapInArrow(
        read, "doc_id long, row long, ids binary, words array<long>, times array<long>, tokens long, known long, base double, net double"
    )
    numbered = scratch.save(numbered.withColumn("round", F.when(learn & picked, dealt).otherwise(-1)), "round")
    model = train(numbered.where("round >= 0").select("doc_id", "ids", "round"), vocabulary, np.append(n[:size], rare_n), rounds, tasks)

    def network(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each word that is still to be counted and one for the document, whose word is no other's."""
        end = vocabulary.number(np.array([END], np.uint64), np.zeros(1, np.int64))[0]
        for batch in batches:
            words, times = batch.column("words"), batch.column("times")
            n = pc.list_value_length(words).to_numpy()
            last = np.cumsum(n + 1) - 1
            which = np.repeat(np.arange(len(n)), n + 1)
            other = np.ones(len(which), bool)
            other[last] = False

            def spread(of_words: np.ndarray | None, of_docs: np.ndarray) -> pa.Array:
                out = np.zeros(len(which), of_docs.dtype)
                out[last] = of_docs
                if of_words is not None:
                    out[other] = of_words
                return pa.array(out)

            own = {c: batch.column(c).to_numpy() for c in ("row", "tokens", "known", "base", "net")}
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(which)), pa.array(own["row"][which]),
                spread(words.flatten().to_numpy(), np.int64(np.uint64(END).astype(np.int64)) ^ own["row"]), spread(times.flatten().to_numpy(), np.zeros(len(n), np.int64)),
                spread(None, own["tokens"]), spread(None, own["known"]), spread(None, own["base"]), spread(None, own["net"] + _document_scores(model, _ids_of(batch), end)),
            ], ["doc_id", "row", "word", "times", "tokens", "known", "base", "net"])

    few = numbered.drop("round").coalesce(max(spark.sparkContext.defaultParallelism, numbered.count() // SCORED_ROWS))
    emitted = few.mapInArrow(network, "doc_id long, row long, word long, times long, tokens long, known long, base double, net double")
    of_word = F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTH))
    return (
        emitted.join(counts.select("word", "n"), "word", "left").groupBy("row").agg(
            F.max("doc_id").alias("doc_id"), F.sum("tokens").alias("n_tokens"),
            F.sum(F.col("known") + F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("n_known"),
            F.sum(F.col("base") + of_word).alias("base_score"), F.sum(F.col("net") + of_word).alias("score"),
        )
        .select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
    )

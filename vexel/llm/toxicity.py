"""Toxicity score by a subsequence string kernel, Nystroem landmarks and a linear support vector machine.

A word is the weighted bag of its letter triples, in order but not necessarily adjacent: every
letter skipped inside a triple halves its weight, so ``i-d-i-o-t`` and ``idxiot`` stay close to
``idiot``. The kernel of two words is the cosine of their bags, cut off at a floor so that chance
resemblance counts nothing; the kernel of two sentences is the sum over their word pairs. The
floor costs the kernel its positive definiteness: the Nystroem map, the inverse root of the
landmarks' own kernel, lifts eigenvalues to :data:`LEAST` at least. On this map a squared-hinge
machine is trained over sentences of labelled documents that hold a word near a landmark: all
those of clean documents, and of a toxic document the two that score highest, chosen anew in each round. A document scores as its three highest sentences together, as a
probability: a single doubtful word weighs less than several.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Labelled documents used for training, of each label at most, and the bytes of their texts: a
#: document that would bring these beyond the bound is left out as a whole.
MAX_LABELLED, MAX_LABELLED_BYTES = 700, 32_000_000
#: Landmark words: those of toxic texts that tell them apart, and words of clean texts that resemble these most.
LANDMARKS, HARD_NEGATIVES = 128, 48
#: Least eigenvalue of the landmarks' own kernel.
LEAST = 1e-3
THRESHOLD = 0.3
#: Kernel values below this are chance resemblance.
FLOOR = 0.35
SENTENCE_WORDS = 24
#: Sentences of a toxic document that are examples, and sentences that a document's score adds up.
EXAMPLES, HIGHEST = 2, 3
_GAPS = [(1, 1), (1, 2), (2, 1), (1, 3), (3, 1), (2, 2)]
_SIGNS = 33  # 26 letters, 6 groups of other letters, the start of a word
_START = 32
_GROUPS = 16
#: Words and triples handled at a time, for memory.
_CHUNK_WORDS, _CHUNK_TRIPLES = 20_000, 30_000
_BLOCK_BYTES = 8_000_000
#: Words whose value a task remembers before it starts afresh (about 100 bytes each).
_KNOWN_WORDS = 1_000_000
# Digits and signs commonly put for letters.
_LOOKS_LIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}


class _Signs(dict):
    """Character to sign for ``str.translate``: letters to themselves or a group, all else to a gap."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        c = _LOOKS_LIKE.get(c, c)
        if "a" <= c <= "z":
            sign = ord(c) - 97
        else:
            sign = 26 + code % 6 if c.isalpha() else 255
        self[code] = chr(sign)
        return self[code]


_TABLE = _Signs()


def spelled(words: list[str]) -> list[str]:
    """Join runs of three or more one-letter words, so that ``i d i o t`` is one word."""
    out, run = [], []
    for w in words:
        if len(w) == 1 and w.isalpha():
            run.append(w)
            continue
        if run:
            out += ["".join(run)] if len(run) > 2 else run
            run = []
        out.append(w)
    return out + (["".join(run)] if len(run) > 2 else run)


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Triples of all words, by word: word's place, triple, weight; and each word's norm."""
    coded = [chr(_START) + w.translate(_TABLE) for w in words]
    flat = np.frombuffer("".join(coded).encode("latin-1"), dtype=np.uint8).astype(np.int64)
    word = np.repeat(np.arange(len(words)), [len(c) for c in coded])
    owners, found, weights = [], [], []
    for d1, d2 in _GAPS:
        n = len(flat) - d1 - d2
        if n <= 0:
            continue
        a, b, c = flat[:n], flat[d1 : d1 + n], flat[d1 + d2 :]
        ok = (word[:n] == word[d1 + d2 :]) & (a < 255) & (b < 255) & (c < 255)
        owners.append(word[:n][ok])
        found.append(((a * _SIGNS + b) * _SIGNS + c)[ok])
        weights.append(np.full(int(ok.sum()), 0.5 ** (d1 + d2 - 2)))
    if not owners:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.ones(len(words))
    owner, triple, weight = (np.concatenate(x) for x in (owners, found, weights))
    order = np.argsort(owner, kind="stable")
    owner, triple, weight = owner[order], triple[order], weight[order]
    norm = np.sqrt(np.bincount(owner, weight * weight, minlength=len(words)))
    return owner, triple, weight, np.where(norm > 0, norm, 1.0)


@dataclass
class Kernel:
    """Landmark bags as a dense table of triples; ``most`` has the greatest weight in each group of landmarks."""

    table: np.ndarray
    most: np.ndarray

    @staticmethod
    def of(landmarks: list[str]) -> Kernel:
        owner, triple, weight, norm = triples(landmarks)
        table = np.zeros((_SIGNS**3, len(landmarks)), dtype=np.float32)
        np.add.at(table, (triple, owner), (weight / norm[owner]).astype(np.float32))
        return Kernel.from_table(table)

    @staticmethod
    def from_table(table: np.ndarray) -> Kernel:
        """Landmarks that share triples are grouped, which keeps the groups' bounds tight."""
        gram = table.T @ table
        group, free = np.zeros(table.shape[1], dtype=np.int64), np.ones(table.shape[1], dtype=bool)
        size = -(-table.shape[1] // _GROUPS)
        for g in range(_GROUPS):
            if free.any():
                seed = int(np.argmax(free))
                near = np.argsort(-np.where(free, gram[seed], -1), kind="stable")[:size]
                near = near[free[near]]
                group[near], free[near] = g, False
        most = np.zeros((len(table), _GROUPS), dtype=np.float32)
        for g in range(_GROUPS):
            if (group == g).any():
                most[:, g] = table[:, group == g].max(axis=1)
        return Kernel(table, most)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that resemble some landmark, and their kernel values above the floor."""
        parts = [(a, *self._near(words[a : a + _CHUNK_WORDS])) for a in range(0, len(words), _CHUNK_WORDS)]
        if not parts:
            return np.zeros(0, int), np.zeros((0, self.table.shape[1]), dtype=np.float32)
        return np.concatenate([a + near for a, near, _ in parts]), np.concatenate([v for _, _, v in parts])

    def _near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        owner, triple, weight, norm = triples(words)
        weight = weight.astype(np.float32)
        # What a group's greatest weights come to bounds the kernel with each of its landmarks.
        bound = _sums(self.most, owner, triple, weight, len(words)).max(axis=1) / norm
        near = np.flatnonzero(bound >= FLOOR)
        place = np.full(len(words), -1)
        place[near] = np.arange(len(near))
        mine = place[owner] >= 0
        values = _sums(self.table, place[owner[mine]], triple[mine], weight[mine], len(near))
        values /= norm[near, None]
        values = np.clip((values - FLOOR) / (1 - FLOOR), 0, 1)
        some = values.any(axis=1)
        return near[some], values[some]


def _sums(table: np.ndarray, at: np.ndarray, triple: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Weighted sums of table rows by ``at``, which is sorted."""
    out = np.zeros((n, table.shape[1]), dtype=np.float32)
    for lo in range(0, len(at), _CHUNK_TRIPLES):
        hi = min(len(at), lo + _CHUNK_TRIPLES)
        heads = np.flatnonzero(np.diff(at[lo:hi], prepend=-1))
        out[at[lo:hi][heads]] += np.add.reduceat(table[triple[lo:hi]] * weight[lo:hi, None], heads, axis=0)
    return out


def sentences(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words; for every word of the texts its place among these, its sentence and its text.

    A sentence ends with a word that ends in ``.``, ``!`` or ``?``, with its text, or after
    :data:`SENTENCE_WORDS` words.
    """
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    flat = lists.flatten()
    single = pc.and_(pc.equal(pc.utf8_length(flat), 1), pc.utf8_is_alpha(flat)).to_numpy(zero_copy_only=False)
    counts = np.diff(offsets)
    text = np.repeat(np.arange(len(counts)), counts)
    runs = single[:-2] & single[1:-1] & single[2:]
    if runs.any():
        # Only texts with a run of one-letter words are taken apart.
        odd = np.unique(text[:-2][runs])
        parts = lists.to_pylist()
        for k in odd:
            parts[k] = spelled(parts[k])
        lists = pa.array(parts, pa.list_(pa.string()))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.flatten()
        counts = np.diff(offsets)
        text = np.repeat(np.arange(len(counts)), counts)
    coded = flat.dictionary_encode()
    at = coded.indices.to_numpy().astype(np.int64)
    stops = pc.match_substring_regex(coded.dictionary, r"[.!?]$").to_numpy(zero_copy_only=False)
    ends = stops[at] if len(at) else np.zeros(0, bool)
    first = np.zeros(len(at), dtype=bool)
    first[offsets[:-1][counts > 0]] = True
    first[1:] |= ends[:-1]
    head = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0)) if len(at) else np.zeros(0, int)
    first |= (np.arange(len(at)) - head) % SENTENCE_WORDS == 0
    return coded.dictionary.to_pylist(), at, np.cumsum(first) - 1, text


@dataclass
class Model:
    """Landmark table, weight of each landmark, bias of a sentence, and the scale to probability."""

    kernel: Kernel
    beta: np.ndarray
    bias: float
    slope: float
    shift: float
    known: dict[str, float] = field(default_factory=dict)

    def _values(self, words: list[str]) -> np.ndarray:
        """What each word adds to its sentence's margin."""
        known = self.known
        if len(known) > _KNOWN_WORDS:
            known.clear()
        new = [w for w in words if w not in known]
        if new:
            value = np.zeros(len(new))
            near, features = self.kernel(new)
            value[near] = features @ self.beta
            known.update(zip(new, value.tolist(), strict=True))
        return np.fromiter(map(known.__getitem__, words), dtype=float, count=len(words))

    def margins(self, texts: pa.Array) -> np.ndarray:
        """Sum of each text's highest sentence margins; missing sentences count as empty ones."""
        words, at, sentence, text = sentences(texts)
        value = self._values(words)
        if not len(at):
            return np.full(len(texts), HIGHEST * self.bias)
        total = np.bincount(sentence, value[at]) + self.bias
        of = np.zeros(len(total), dtype=np.int64)
        of[sentence] = text
        return _highest(total, of, len(texts), self.bias)

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -30, 30)))


def _highest(total: np.ndarray, of: np.ndarray, n: int, empty: float) -> np.ndarray:
    """Sum of the :data:`HIGHEST` greatest totals of each of ``n`` texts; ``empty`` for each one missing."""
    order = np.lexsort((-total, of))
    first = np.searchsorted(of[order], np.arange(n))
    rank = np.arange(len(order)) - first[of[order]]
    top = order[rank < HIGHEST]
    count = np.bincount(of[top], minlength=n)
    return np.bincount(of[top], total[top], minlength=n) + (HIGHEST - count) * empty


def _candidates(words: list[str], present: np.ndarray, text: np.ndarray, label: np.ndarray) -> list[str]:
    """Words of toxic texts, those first whose groups of four letters tell them from clean texts best."""
    coded = [chr(_START) + "".join(c for c in w.translate(_TABLE) if c != "\xff") for w in words]
    flat = np.frombuffer("".join(coded).encode("latin-1"), dtype=np.uint8).astype(np.int64)
    length = np.asarray([len(c) for c in coded])
    word = np.repeat(np.arange(len(words)), length)
    n = max(0, len(flat) - 3)
    whole = word[:n] == word[3:]
    word = word[:n][whole]
    gram = (((flat[:n] * _SIGNS + flat[1 : n + 1]) * _SIGNS + flat[2 : n + 2]) * _SIGNS + flat[3:])[whole]
    first = np.searchsorted(word, np.arange(len(words) + 1))
    texts_with = np.zeros((2, _SIGNS**4), dtype=np.int32)
    bounds = np.searchsorted(text, np.arange(len(label) + 1))
    for t in range(len(label)):
        mine = np.unique(present[bounds[t] : bounds[t + 1]])
        count = first[mine + 1] - first[mine]
        at = np.repeat(first[mine] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        texts_with[int(label[t]), np.unique(gram[at])] += 1
    n1, n0 = max(1, int(label.sum())), max(1, int((~label).sum()))
    odds = np.log((texts_with[1] + 0.1) / (n1 + 1)) - np.log((texts_with[0] + 0.5) / (n0 + 1))
    # A group met in two toxic texts by chance must not outrank one met in many.
    odds = np.where((texts_with[1] > 1) & (odds > 1), odds * np.sqrt(texts_with[1]), -9)
    value = odds[gram]
    order = np.lexsort((-value, word))
    rank = np.arange(len(word)) - first[word[order]]
    top = order[rank < 3]
    score = np.bincount(word[top], value[top], minlength=len(words)) / 3
    best = np.full(len(words), -np.inf)
    np.maximum.at(best, word, value)
    toxic = np.zeros(len(words), dtype=bool)
    toxic[present[label[text]]] = True
    good = np.flatnonzero(toxic & (best > 1) & (length <= 25))
    return [words[w] for w in good[np.lexsort((good, -score[good]))]]


def train(texts: list[str], labels: list[int]) -> Model:
    """Fit on whole texts and their 0/1 labels. With one label only, all texts score as its share."""
    label = np.asarray(labels, dtype=bool)
    if not label.any() or label.all():
        share = float(np.clip(label.mean() if len(label) else 0.0, 0.01, 0.99))
        return Model(Kernel.of(["a"]), np.zeros(1), 0.0, 0.0, float(np.log(share / (1 - share))))
    words, at, sentence, text = sentences(pa.array(texts, pa.string()))
    landmarks: list[str] = []
    chosen = None
    for w in _candidates(words, at, text, label)[: 20 * LANDMARKS]:
        if len(landmarks) >= LANDMARKS:
            break
        owner, triple, weight, norm = triples([w])
        bag = np.bincount(triple, weight, minlength=_SIGNS**3).astype(np.float32) / norm[0]
        if chosen is None or (chosen[: len(landmarks), triple] @ bag[triple]).max(initial=0) < 0.75:
            if chosen is None:
                chosen = np.zeros((LANDMARKS, _SIGNS**3), dtype=np.float32)
            chosen[len(landmarks)] = bag
            landmarks.append(w)
    del chosen
    landmarks = landmarks or [words[at[0]]]
    # Words of clean texts that resemble these most, so that the machine can tell them apart.
    near, values = Kernel.of(landmarks)(words)
    clean = np.zeros(len(words), dtype=bool)
    clean[at[~label[text]]] = True
    order = near[np.argsort(-values.max(axis=1), kind="stable")] if len(near) else near
    landmarks += [words[w] for w in order if clean[w] and words[w] not in landmarks][:HARD_NEGATIVES]

    kernel = Kernel.of(landmarks)
    near, values = kernel(words)
    row = np.full(len(words), -1)
    row[near] = np.arange(len(near))
    hit = row[at] >= 0
    # Sentences without any landmark are all alike and need no row.
    some, where = np.unique(sentence[hit], return_inverse=True)
    features = np.zeros((len(some), len(landmarks)), dtype=np.float32)
    np.add.at(features, where, values[row[at[hit]]])
    of = np.zeros(int(sentence.max()) + 1, dtype=np.int64)
    of[sentence] = text
    whole = np.bincount(of, minlength=len(label))
    of = of[some]
    del words, at, sentence, text, values, row, hit

    # Nystroem map: the inverse square root of the landmarks' own kernel.
    own_at, own = kernel(landmarks)
    gram = np.zeros((len(landmarks),) * 2)
    gram[own_at] = own
    vals, vecs = np.linalg.eigh((gram + gram.T) / 2 + LEAST * np.eye(len(landmarks)))
    root = (vecs @ np.diag(np.maximum(vals, LEAST) ** -0.5) @ vecs.T).astype(np.float32)
    spare = whole - np.bincount(of, minlength=len(label))  # sentences of each text without a row
    clean = np.flatnonzero(~label[of])
    # Sentences without a row could only move the bias, which the scale to probability sets anew.
    negative = features[clean] @ root
    rank = features.max(axis=1)
    w, b = np.zeros(len(landmarks)), 0.0
    for _ in range(3):
        by_text = np.lexsort((-rank, of))
        place = np.arange(len(of)) - np.searchsorted(of[by_text], of[by_text])
        positive = by_text[(place < EXAMPLES) & label[of[by_text]]]
        x = np.concatenate([features[positive] @ root, negative])
        y = np.repeat([1.0, -1.0], [len(positive), len(negative)])
        weight = np.concatenate([np.full(len(part), 0.5 / max(1, len(part))) for part in (positive, negative)])
        w, b = _squared_hinge(x, y, weight)
        rank = features @ (root @ w).astype(np.float32)
    # Of the sentences without a row, which have the bias as their margin, as many as matter.
    spare = np.minimum(spare, HIGHEST)
    total = np.concatenate([rank + b, np.full(int(spare.sum()), b)])
    owner = np.concatenate([of, np.repeat(np.arange(len(label)), spare)])
    slope, shift = _platt(_highest(total, owner, len(label), b), label)
    return Model(kernel, root @ w, b, slope, shift)


def _squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Primal Newton steps of the squared-hinge machine, over a few rows at a time; the bias is the last weight."""
    d = x.shape[1] + 1
    w = np.zeros(d)
    penalty = ridge * np.eye(d)
    penalty[-1, -1] = 1e-8
    for _ in range(30):
        bend, pull = penalty.copy(), -penalty @ w
        for lo in range(0, len(x), _CHUNK_WORDS):
            part = slice(lo, lo + _CHUNK_WORDS)
            slack = 1 - y[part] * (x[part] @ w[:-1] + w[-1])
            on = np.flatnonzero(slack > 0)
            z = np.concatenate([x[part][on], np.ones((len(on), 1))], axis=1).astype(float)
            c = weight[part][on]
            bend += (z * c[:, None]).T @ z
            pull += (c * y[part][on] * slack[on]) @ z
        step = np.linalg.solve(bend, pull)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _platt(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic scale, towards smoothed targets."""
    n1, n0 = label.sum(), (~label).sum()
    target = np.where(label, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z = np.stack([margin, np.ones(len(margin))], axis=1)
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, z.T @ (target - p))
        w += np.clip(step, -2, 2)
    return float(w[0]), float(w[1])


def labelled(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """Training texts and labels: of each label the :data:`MAX_LABELLED` documents with the least CRC-32.

    Documents whose CRC-32 of the id as text has remainder 2 modulo 4 are left out, and those
    whose texts, in that order and both labels in turn, would come to more than
    :data:`MAX_LABELLED_BYTES`. A document with several labels is toxic if one is; null ids and
    labels are ignored. Of an id that documents repeat, the greatest text is taken.
    """
    check = F.crc32(F.col("doc_id").cast("string"))
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (check % 4 != 2))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    parts = [known.where(F.col("toxic") == v).orderBy(check, "doc_id").limit(MAX_LABELLED) for v in (0, 1)]
    few = F.broadcast(parts[0].union(parts[1]))  # 2 * MAX_LABELLED rows at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(few, "doc_id").where(F.col("text").isNotNull())
    # An id repeated in documents must not lift the bound on what is collected.
    rows = rows.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    rank = F.row_number().over(Window.partitionBy("toxic").orderBy(check, "doc_id"))
    rows = rows.withColumn("rank", rank).withColumn("bytes", F.sum(F.octet_length("text")).over(Window.orderBy("rank", "toxic")))
    rows = rows.where(F.col("bytes") <= MAX_LABELLED_BYTES).orderBy("doc_id").select("text", "toxic").toArrow()
    return rows["text"].to_pylist(), [int(t) for t in rows["toxic"].to_pylist()]


def score(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``score`` (0 to 1) and ``predicted`` (0 or 1) of every row, from the text alone, beside the columns ``carry``.

    All columns are carried if none are given, but for any of these two names. Null and empty
    texts score as a sentence without any landmark. An empty input gives no rows.
    """
    names = [c for c in (docs.columns if carry is None else carry) if c.lower() not in ("score", "predicted")]
    # Plain arrays: what is broadcast is unpickled where this module may not be installed.
    shared = docs.sparkSession.sparkContext.broadcast((model.kernel.table, model.beta, model.bias, model.slope, model.shift))
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)], F.col(f"`{text_col}`").cast("string").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[:-1])
    schema = f"{fields}{', ' if fields else ''}score double, predicted int"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, *rest = shared.value
        scorer = Model(Kernel.from_table(table), *rest)
        for batch in batches:
            texts = batch.column("_text")
            block = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)) // _BLOCK_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    part = batch.slice(a, b - a)
                    found = scorer.scores(part.column("_text"))
                    columns = [*part.columns[:-1], pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[:-1], "score", "predicted"])

    out = inner.mapInArrow(task, schema)
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], "score", "predicted")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def crc_remainder(doc_id: int) -> int:
    """The remainder that decides whether a document is held out."""
    return zlib.crc32(str(doc_id).encode()) % 4

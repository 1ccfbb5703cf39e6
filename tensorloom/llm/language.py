"""Language identification: script ranges, per-word scores, and Viterbi spans of mixed text."""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.shipping import ship

from .common import chosen, row_keys, slices, written

#: Documents of each language that training reads, as expected by a hash of the id.
TRAIN_PER_LANG = 1500
#: Languages that one model tells apart, more than there are living ones; beyond it an error is raised.
MOST_LANGS = 10_000
#: Cells of words times languages that a task scores at once, and those that it remembers.
AT_ONCE, REMEMBERED = 2_400_000, 1_200_000
#: What words, trigrams and scripts of a language that have not been seen in it count.
PRIOR = {"w": 0.05, "g": 0.5, "s": 0.0001}
#: Words that Viterbi goes on before it packs the way back.
STRIDE = 1_024
#: What a change of language costs, and how far one word can speak against a language, in nats.
SWITCH, FLOOR = 8.0, 6.0
#: First code point of each range of letters (fixed values of the Unicode blocks).
SCRIPTS = ((0x41, "latin"), (0x250, "ipa"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "indic"), (0xE00, "thai"), (0xE80, "lao"), (0x1000, "asian"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"))
_STARTS = [s for s, _ in SCRIPTS]


def script(word: str) -> str | None:
    """The script of the first letter; None without a letter."""
    for c in word:
        if c.isalpha():
            return SCRIPTS[max(0, bisect.bisect_right(_STARTS, ord(c)) - 1)][1]
    return None


def plain(word: str) -> str:
    """The word in lower case from its first to its last letter."""
    if word.isalpha():
        return word.lower()
    n, m = 0, len(word)
    while n < m and not word[n].isalpha():
        n += 1
    while m > n and not word[m - 1].isalpha():
        m -= 1
    return word[n:m].lower()


def grams(word: str) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


def hashed(item: str) -> int:
    return xxhash.xxh64_intdigest(item)


@dataclass
class Table:
    """Log likelihoods of items by language: `unseen` for each language, and `more` for the languages that have an item.

    Items are sorted hashes; item n has the entries from begin[n] to begin[n + 1]. So the table is as
    large as what the sample holds, however many languages there are.
    """

    items: np.ndarray
    begin: np.ndarray
    langs: np.ndarray
    more: np.ndarray
    unseen: np.ndarray

    @staticmethod
    def of(items: np.ndarray, langs: np.ndarray, n: np.ndarray, size: np.ndarray, prior: float) -> Table:
        order = np.argsort(items, kind="stable")
        names, begin = np.unique(items[order], return_index=True)
        unseen = np.log(prior / (size + prior * (len(names) + 1)))
        return Table(names, np.append(begin, len(items)), langs[order], np.log(n[order] / prior + 1), unseen)

    def places(self, asked: np.ndarray) -> np.ndarray:
        """Where the items are, -1 where they haven't been seen."""
        if not len(self.items):
            return np.full(len(asked), -1)
        at = np.minimum(np.searchsorted(self.items, asked), len(self.items) - 1)
        return np.where(self.items[at] == asked, at, -1)

    def added(self, rows: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
        """For each of n rows and each language the sum over the row's items."""
        k = len(self.unseen)
        out = np.bincount(rows, minlength=n)[:, None] * self.unseen
        rows, places = rows[places >= 0], places[places >= 0]
        count = self.begin[places + 1] - self.begin[places]
        if total := int(count.sum()):
            at = np.repeat(self.begin[places] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(total)
            out += np.bincount(np.repeat(rows, count) * k + self.langs[at], self.more[at], n * k).reshape(n, k)
        return out


@dataclass
class Model:
    """What words and trigrams speak for which language; scripts: those in which a language writes."""

    langs: list[str]
    words: Table
    grams: Table
    scripts: dict[int, np.ndarray]

    def scores(self, words: list[str]) -> np.ndarray:
        """How much each word, which has letters, speaks for each language; 0 for the best. Words not seen go by their trigrams."""
        low = [plain(w) for w in words]
        at = self.words.places(np.array([hashed(w) for w in low], np.uint64))
        known, unknown = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        out = np.empty((len(words), len(self.langs)))
        out[known] = self.words.added(np.arange(len(known)), at[known], len(known))
        parts = [grams(low[n]) for n in unknown.tolist()]
        rows = np.repeat(np.arange(len(unknown)), [len(g) for g in parts])
        out[unknown] = self.grams.added(rows, self.grams.places(np.array([hashed(g) for own in parts for g in own], np.uint64)), len(unknown))
        out = np.maximum(out - out.max(1, keepdims=True), -FLOOR) if len(out) else out
        kinds = np.array([script(w) for w in words])
        for kind in set(kinds.tolist()):
            allowed = self.scripts.get(hashed(kind))
            if allowed is not None and allowed.any():
                out[np.ix_(kinds == kind, ~allowed)] = -2 * FLOOR
        return out


def _sampled(rows: DataFrame, per_lang: int) -> DataFrame:
    """About per_lang rows of each language, chosen by a hash of the id; null ids share one. Only the shares, one row per language, go to all tasks."""
    counts = rows.groupBy("lang").count().limit(MOST_LANGS + 1).collect()
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    shares = rows.sparkSession.createDataFrame([(r["lang"], min(1.0, per_lang / r["count"])) for r in counts], "lang string, share double")
    return rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < F.col("share") * (1 << 30))


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int = TRAIN_PER_LANG) -> Model:
    """A model of the languages of docs, from about per_lang texts of each, counted on the executors.

    All words and trigrams of these texts enter. The driver takes a row for each language and each
    word that it has in the sample, which does not grow with docs.
    """
    ship(docs.sparkSession)
    rows = _sampled(docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), per_lang)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in slices(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for word, n in Counter(text.split()).items():
                    if kind := script(word):
                        found[lang, "s", kind] += n
                        found[lang, "w", low := plain(word)] += n
                        for g in grams(low):
                            found[lang, "g", g] += n
        keys = list(found)
        items = np.array([hashed(x) for _, _, x in keys], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _, _ in keys], pa.string()), pa.array([x for _, x, _ in keys], pa.string()), pa.array(items), pa.array(list(found.values()), pa.int64())], names=["lang", "kind", "item", "n"])

    counts = rows.select("lang", "text").mapInArrow(count, "lang string, kind string, item long, n long").groupBy("kind", "item", "lang").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts.column("lang").to_pylist()))
    place = {x: n for n, x in enumerate(langs)}
    kinds, lang = counts.column("kind").to_numpy(), np.array([place[x] for x in counts.column("lang").to_pylist()], np.int32)
    items, n = counts.column("item").to_numpy().view(np.uint64), counts.column("n").to_numpy().astype(float)

    def table(kind: str) -> Table:
        own = kinds == kind
        return Table.of(items[own], lang[own], n[own], np.bincount(lang[own], n[own], len(langs)), PRIOR[kind])

    letters = table("s")
    rates = np.exp(letters.added(np.arange(len(letters.items)), np.arange(len(letters.items)), len(letters.items)))
    return Model(langs, table("w"), table("g"), {int(x): r > 0.002 for x, r in zip(letters.items, rates, strict=True)})


class _Ids(dict):
    """Word to row of scores; row 0 is that of a word without letters."""

    def __init__(self, model: Model):
        self.model, self.rows, self.n = model, [np.zeros((1, len(model.langs)))], 1

    def learn(self, texts: list[list[str]]) -> None:
        """Gives the words of texts their rows."""
        new = [w for w in set().union(*texts) if w not in self]
        lettered = [w for w in new if script(w) is not None]
        self.update(dict.fromkeys(new, 0))
        self.update(zip(lettered, range(self.n, self.n + len(lettered)), strict=True))
        self.n += len(lettered)
        step = 1 + AT_ONCE // max(1, len(self.model.langs))
        self.rows = [np.concatenate([*self.rows, *(self.model.scores(lettered[at : at + step]) for at in range(0, len(lettered), step))])]


def viterbi(scores: np.ndarray, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word, over many texts at a time.

    ids has the texts' words one after the other, as rows of scores; text d begins at starts[d].
    A change of label from one word to the next costs `switch`. The way back is packed every STRIDE
    words: four bytes, and a bit for each label, for a word.
    """
    labels = np.zeros(len(ids), np.int32)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")
    ways, v = [], np.zeros((len(lengths), scores.shape[1]))
    for first in range(0, len(active), STRIDE):
        n = int(active[first])
        steps = min(STRIDE, len(active) - first)
        best_of, moved = np.empty((steps, n), np.int32), np.zeros((steps, n, scores.shape[1]), bool)
        for t in range(first, first + steps):
            n = int(active[t])
            v = v[:n]
            best_of[t - first, :n] = best = v.argmax(1)
            other = v[np.arange(n), best][:, None] - switch
            moved[t - first, :n] = v < other
            v = np.maximum(v, other) + scores[ids[starts[:n] + t]]
            further = int(active[t + 1]) if t + 1 < len(active) else 0
            labels[starts[further:n] + t] = v[further:].argmax(1)  # texts that end here
        ways.append((best_of, np.packbits(moved, axis=2)))
    for t in range(len(active) - 2, -1, -1):
        best_of, moved = ways[(t + 1) // STRIDE]
        at, n = (t + 1) % STRIDE, int(active[t + 1])
        after = labels[starts[:n] + t + 1]
        went = moved[at, np.arange(n), after >> 3] >> (7 - (after & 7)).astype(np.uint8) & 1
        labels[starts[:n] + t] = np.where(went, best_of[at, :n], after)
    return labels


def _label_batch(model: Model, cache: _Ids, texts: list[str | None], switch: float):
    """Per text: predicted language, its share of the words with letters, and the spans."""
    if not model.langs:
        return ["und"] * len(texts), np.zeros(len(texts)), pa.array([[]] * len(texts), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))
    tokens = [(t or "").split() for t in texts]
    cache.learn(tokens)
    ids = [list(map(cache.__getitem__, own)) for own in tokens]
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(ids) else lengths
    flat = np.fromiter((x for own in ids for x in own), np.int64, int(lengths.sum()))
    labels = viterbi(cache.rows[0], flat, starts, lengths, switch) if len(flat) else np.zeros(0, np.int32)
    doc = np.repeat(np.arange(len(ids)), lengths)
    k = len(model.langs)
    votes = np.bincount(doc[flat > 0] * k + labels[flat > 0], minlength=len(ids) * k).reshape(len(ids), k)
    change = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (labels[1:] != labels[:-1])])) if len(flat) else np.zeros(0, np.int64)
    ends = np.append(change[1:], len(flat)) if len(flat) else change
    total = votes.sum(1)
    best = votes.argmax(1)
    names = [model.langs[b] if n else "und" for b, n in zip(best, total, strict=True)]
    share = np.where(total > 0, votes[np.arange(len(ids)), best] / np.maximum(total, 1), 0.0)
    first = np.searchsorted(doc[change], np.arange(len(ids) + 1)) if len(flat) else np.zeros(len(ids) + 1, int)
    inner = pa.StructArray.from_arrays([pa.array(change - starts[doc[change]] if len(flat) else [], pa.int64()), pa.array(ends - starts[doc[change]] if len(flat) else [], pa.int64()), pa.array([model.langs[x] for x in labels[change]] if len(flat) else [], pa.string())], ["start", "end", "lang"])
    return names, share, pa.ListArray.from_arrays(pa.array(first, pa.int32()), inner)


def label(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH, words_at_once: int = 600_000) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, spans.

    The script of a word leaves the languages that write in it; words get log likelihoods under
    each (letter trigrams where the word is unknown), and Viterbi, with a price on each change of
    language, labels the words. spans has the runs, as word numbers from start up to end. lang_pred
    is the language of most words with letters, score its share of them. Null, empty and letterless
    texts are `und` with score 0, and so is all if the model has no language. Ties go to the
    language that comes first by name. Only the text is read. Rows that repeat get the same answer
    each; null ids stay null. Very long texts are labelled whole. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))])

    shared, k = docs.sparkSession.sparkContext.broadcast(model), max(8, len(model.langs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        cache = _Ids(model)
        for b in slices(batches, 1 + 16_000 // k):
            doc, texts, at = b.column(0), b.column(1).to_pylist(), 0
            while at < len(texts):
                end, words = at, 0
                while end < len(texts) and (end == at or words < words_at_once):
                    words += len(texts[end] or "") // 5 + 1
                    end += 1
                if len(cache) * k > REMEMBERED:
                    cache = _Ids(model)
                names, share, spans = _label_batch(model, cache, texts[at:end], switch)
                yield pa.RecordBatch.from_arrays([doc.slice(at, end - at).cast(pa.int64()), pa.array(names, pa.string()), pa.array(share, pa.float64()), spans.cast(schema.types[3])], schema=schema)
                at = end

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>")


def held_out(doc_id, parts: int, part: int):
    """Whether crc32 of the id as text leaves `part` on division by `parts`."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = TRAIN_PER_LANG) -> DataFrame:
    """label() of all rows, with a model of those that aren't held out (crc32 of the id mod 4 is not 2)."""
    model = train(docs.where(~held_out(F.col(id_col), 4, 2)), id_col, text_col, lang_col, per_lang)
    return label(docs, model, id_col, text_col)


def accepted(docs: DataFrame, least_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose text has letters and one language for at least least_share of its words.

    Ids may be null or repeat; rows go by their own texts. Null, empty and letterless texts go; long
    ones are labelled whole. An empty table gives no rows. All columns keep their names and values,
    whatever they are called.
    """
    rows, key = row_keys(docs, id_col)
    good = identify(rows, key, text_col, lang_col).where((F.col("lang_pred") != "und") & (F.col("score") >= least_share))
    return chosen(rows, key, good.select("doc_id"), docs.columns)

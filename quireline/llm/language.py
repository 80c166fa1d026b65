"""Problem 5: a language for every document and every foreign segment.

Method: hierarchical discrimination. A linear classifier over hashed character
n-grams and script shares first predicts the family; one-versus-one linear
support vector machines then separate the languages within it and vote. Both are
trained here, at run time, on a bounded sample of labelled rows (the bound is a
parameter); labels are dirty, so training drops the rows that the model of the
first pass puts elsewhere and trains again. Everything else covers all rows: each
sentence of each document is classified, and the main language is that of most of
a document's letters.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from quireline.llm.common import need, parts_of
from quireline.llm.sentences import sentence_ends
from quireline.llm.unify import readable

# Families of closely related languages, by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl sv da no is af",
    "romance": "fr es pt it ca ro gl oc",
    "slavic_latin": "pl cs sk sl hr bs",
    "cyrillic": "ru uk bg sr be mk",
    "arabic": "ar fa ur ps",
    "indic": "hi mr ne bn gu pa ta te kn ml",
    "east_asian": "zh ja ko",
    "uralic_turkic": "fi et hu tr az",
    "hellenic": "el",
    "semitic": "he",
    "mainland": "th vi lo km my id ms",
}
LATIN_FAMILIES = ("germanic", "romance", "slavic_latin", "uralic_turkic", "mainland")
FAMILY_OF = {lang: fam for fam, langs in FAMILIES.items() for lang in langs.split()}

# Ways to write a language's name; ISO 639-2 and 639-3 codes,
# English and own names. Codes of two letters name themselves.
SPELLINGS = {
    "en": "eng english anglais englisch inglés inglês",
    "fr": "fra fre french français francais französisch francés francês",
    "de": "deu ger german deutsch allemand alemán alemão",
    "es": "spa spanish español espanol castellano espagnol spanisch espanhol",
    "pt": "por portuguese português portugues portugais portugiesisch portugués",
    "it": "ita italian italiano italien",
    "nl": "nld dut dutch nederlands",
    "ru": "rus russian русский russe russisch ruso",
    "ar": "ara arabic العربية عربي arabe arabisch",
    "hi": "hin hindi हिन्दी हिंदी",
    "zh": "zho chi cmn chinese mandarin 中文 汉语 漢語 chinois chinesisch chino",
    "ja": "jpn japanese 日本語 japonais japanisch japonés",
    "ko": "kor korean 한국어",
}
NAMES = {name: code for code, names in SPELLINGS.items() for name in [code, *names.split()]}
# Labels that name no language.
NO_LANGUAGE = ("", "und", "xx", "zxx", "mul", "mis", "none", "null", "unknown", "n/a", "na", "-", "?")

#: Hashed features, longest n-gram, labelled rows per language in the sample.
DIMENSION, GRAM, SAMPLE_PER_LANGUAGE = 1 << 15, 3, 400
#: Letters from which on a text says all it can; a sign of a script of syllables or
#: words counts as three. Fewer take confidence away, so that a name or a number alone
#: doesn't pass for a sentence of another language.
ENOUGH, WORD_SIGN = 12, 3
#: Least confidence of a segment that is called foreign.
LEAST_CONFIDENCE = 0.6
#: Fewest letters and greatest length of a text in the training sample.
TRAIN_LETTERS, TRAIN_SIGNS = 12, (40, 20_000)
#: Greatest weight of a sentence that comes often in the sample.
MOST_WEIGHT = 6
#: Texts whose n-grams are looked up together.
CHUNK = 128
#: How far beyond the margin a row must be to be left alone for one round of training.
MARGIN = 0.1
SEED = 20170102

_SCRIPTS = [
    ("latin", "A-Za-zÀ-ɏ"), ("cyrillic", "Ѐ-ԯ"), ("arabic", "؀-ۿݐ-ݿ"), ("devanagari", "ऀ-ॿ"),
    ("han", "㐀-䶿一-鿿"), ("kana", "぀-ヿ"), ("hangul", "가-힯"), ("greek", "Ͱ-Ͽ"),
    ("hebrew", "֐-׿"), ("thai", "฀-๿"),
]
#: Number of the script of every code point of the Basic Multilingual Plane, 0 for others.
_SCRIPT_OF = np.zeros(0x10000, dtype=np.int64)
for _k, (_, _r) in enumerate(_SCRIPTS):
    for _a, _b in re.findall("(.)-(.)", _r):
        _SCRIPT_OF[ord(_a) : ord(_b) + 1] = _k + 1
#: Scripts whose signs stand for syllables or words.
_WORD_SIGNS = [k for k, (n, _) in enumerate(_SCRIPTS) if n in ("han", "kana", "hangul")]
#: Indexes before those of the n-grams.
RESERVED = 2 * len(_SCRIPTS)
_JUNK = re.compile(r"[A-Za-z0-9+/_=-]{31,}|[A-Za-z_]+[_=]\S*|https?://\S+|[A-Za-z]+\d\w*|\d+[A-Za-z]\w*")
#: Found in every text that holds such junk, and quicker to look for.
_MAYBE_JUNK = re.compile(r"[\d_=/]|\S{31}")
_NAME = re.compile(r"(?<=[^\W_] )[A-ZÀ-ÖØ-Þ][\w'’.&-]*")
_LETTER = re.compile(r"[^\W\d_]")
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def label_code(label: Column) -> Column:
    """ISO 639-1 code that a label names in any spelling, else null."""
    head = F.lower(F.trim(F.regexp_extract(F.trim(label), r"^[\p{L}\p{M}]+", 0)))
    table = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    whole = F.lower(F.trim(label))
    code = F.coalesce(table[whole], table[head], F.when(F.length(head) == 2, head))
    return F.when(label.isNull() | whole.isin(*NO_LANGUAGE) | head.isin(*[x for x in NO_LANGUAGE if x]), F.lit(None)).otherwise(code)


def worded(text: str) -> str:
    """A text without what is no language: codes, addresses and endless runs."""
    return _JUNK.sub(" ", text) if _MAYBE_JUNK.search(text) else text


def letters_only(text: str) -> str:
    """A text's words of letters between blanks, in small letters."""
    clear = worded(text)
    # Capitals inside a sentence begin names, which tell no language.
    short = _NAME.sub("", clear)
    return " " + _NOT_LETTERS.sub(" ", (short if 2 * len(short) > len(clear) else clear).lower()).strip() + " "


def letters_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of ``letters_only``, and how many are of each script (0 for other
    scripts)."""
    codes = np.frombuffer(letters_only(text).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes, np.bincount(_SCRIPT_OF[np.minimum(codes, 0xFFFF)], minlength=len(_SCRIPTS) + 1)[1:]


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes of n-grams as numbers below ``DIMENSION``."""
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(9)) & np.uint32(DIMENSION - 1)


def hashed(codes: np.ndarray) -> np.ndarray:
    """Different hashed n-grams, as rows of the weight table."""
    parts, h = [], np.zeros(len(codes), dtype=np.uint32)
    for n in range(1, min(GRAM, len(codes)) + 1):
        h = h[: len(codes) - n + 1] * np.uint32(0x9E3779B1) + codes[n - 1 :]
        parts.append(mixed(h))
    return np.unique(np.concatenate(parts), sorted=False).astype(np.intp) + RESERVED


def script_features(count: np.ndarray) -> np.ndarray:
    """Shares of the scripts, and from -1 to 1 whether they are there at all."""
    return np.concatenate([count / max(1, int(count.sum())), np.minimum(2.0, count / 2) - 1.0])


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and weights of a text for training: scripts, then n-grams, whose
    weights have the length one together."""
    codes, count = letters_of(text)
    h = hashed(codes)
    return np.concatenate([np.arange(RESERVED), h]), np.concatenate([script_features(count), np.full(len(h), 1.0 / math.sqrt(len(h)))])


Row = tuple[np.ndarray, np.ndarray]


def _train_svm(x: list[Row], y: np.ndarray, weight: np.ndarray, c: float = 2.0, rounds: int = 20) -> np.ndarray:
    """Linear support vector machine (hinge loss) by dual coordinate descent on
    sparse rows; y is ±1, an error costs as much as the row's weight says."""
    w, alpha = np.zeros(DIMENSION + RESERVED), np.zeros(len(x))
    sq = [float(v @ v) + 1e-9 for _, v in x]
    order = np.random.default_rng(SEED)
    top = c * weight
    flat, values = np.concatenate([idx for idx, _ in x]), np.concatenate([val for _, val in x])
    begins = np.cumsum([0] + [len(idx) for idx, _ in x[:-1]])
    for _ in range(rounds):
        # Rows clearly beyond the margin at the start of a round, and those that can't
        # weigh more, stay as they are; every round looks at all of them again.
        slack = y * np.add.reduceat(w[flat] * values, begins) - 1.0
        seen = np.flatnonzero(~((alpha == 0) & (slack > MARGIN)) & ~((alpha >= top) & (slack < -MARGIN)))
        moved = False
        for i in order.permutation(seen):
            idx, val = x[i]
            g = y[i] * float(w[idx] @ val) - 1.0
            if g >= 0 and alpha[i] == 0:
                continue
            new = min(max(alpha[i] - g / sq[i], 0.0), top[i])
            if new != alpha[i]:
                w[idx] += (new - alpha[i]) * y[i] * val
                alpha[i], moved = new, True
        if not moved:
            break
    return w


@dataclass
class Model:
    """Weights of the family classifier and of the pairs within each family."""

    families: list[str]
    family_w: np.ndarray
    members: dict[str, list[str]]
    pairs: dict[tuple[str, str], np.ndarray]
    #: Mean share of each script in the texts of each family.
    scripts: np.ndarray

    def __post_init__(self) -> None:
        names = list(self.pairs)
        #: All weights in one table, a row for each n-gram, so one lookup scores all.
        rows = [self.family_w] + [self.pairs[n][None, :] for n in names]
        self.table = np.ascontiguousarray(np.concatenate(rows).T.astype(np.float32))
        self.place = {n: len(self.families) + k for k, n in enumerate(names)}
        # Families that write a script; a text in another one can't be of theirs.
        self.writers = [[k for k in range(len(self.families)) if self.scripts[k, s] >= 0.1] for s in range(len(_SCRIPTS))]
        # Scores of a text without any script; what is there is added.
        self.bare = -self.table[len(_SCRIPTS) : RESERVED].sum(0)
        self.stamp = hash(self.table.tobytes())

    def classify(self, text: str) -> tuple[str, float]:
        """Language and confidence between 0 and 1; ``("und", 0)`` without letters."""
        return self.judge(text)[:2]

    def tell(self, text: str) -> str:
        """Language of a stored text."""
        return self.judge(readable(text))[0]

    def judge(self, text: str) -> tuple[str, float, int]:
        """Language, confidence and number of letters of a text."""
        codes, count = letters_of(text)
        letters = int(count.sum())
        if not letters:
            return "und", 0.0, 0
        h = hashed(codes)
        total = self.table[h].sum(0) / math.sqrt(len(h)) + self.bare
        for k in count.nonzero()[0].tolist():
            n = int(count[k])
            total += self.table[k] * (n / letters) + self.table[len(_SCRIPTS) + k] * min(2.0, n / 2)
        units = letters + (WORD_SIGN - 1) * int(count[_WORD_SIGNS].sum())
        return self._decide(total.tolist(), int(count.argmax()), letters, min(1.0, math.sqrt(units / ENOUGH)))

    def judge_all(self, texts: list[str]) -> list[tuple[str, float, int]]:
        """The same for many texts; their n-grams are looked up together."""
        out: list[tuple[str, float, int]] = []
        for i in range(0, len(texts), CHUNK):
            out += self._judge_chunk(texts[i : i + CHUNK])
        return out

    def _judge_chunk(self, texts: list[str]) -> list[tuple[str, float, int]]:
        words = [letters_only(t) for t in texts]
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        size = np.array([len(w) for w in words])
        ends = np.cumsum(size)
        owner = np.repeat(np.arange(len(texts)), size)
        kinds = len(_SCRIPTS) + 1
        counts = np.bincount(owner * kinds + _SCRIPT_OF[np.minimum(codes, 0xFFFF)], minlength=len(texts) * kinds).reshape(-1, kinds)[:, 1:]
        letters = counts.sum(1)
        # Hashed n-grams of all texts that don't lie over the end of one; each counts once a text.
        parts, h, left = [], np.zeros(len(codes), dtype=np.uint32), ends[owner] - np.arange(len(codes))
        for n in range(1, min(GRAM, len(codes)) + 1):
            h = h[: len(codes) - n + 1] * np.uint32(0x9E3779B1) + codes[n - 1 :]
            whole = left[: len(h)] >= n
            parts.append(owner[: len(h)][whole] * DIMENSION + mixed(h[whole]))
        keys = np.unique(np.concatenate(parts))
        of, row = keys // DIMENSION, keys % DIMENSION + RESERVED
        many = np.bincount(of, minlength=len(texts))
        total = np.add.reduceat(self.table[row], np.concatenate([[0], np.cumsum(many)[:-1]])) / np.sqrt(many)[:, None]
        given = counts / np.maximum(letters, 1)[:, None]
        total += self.bare + given @ self.table[: len(_SCRIPTS)] + np.minimum(2.0, counts / 2) @ self.table[len(_SCRIPTS) : RESERVED]
        units = letters + (WORD_SIGN - 1) * counts[:, _WORD_SIGNS].sum(1)
        evidence = np.minimum(1.0, np.sqrt(units / ENOUGH))
        return [self._decide(*x) for x in zip(total.tolist(), counts.argmax(1).tolist(), letters.tolist(), evidence.tolist())]

    def _decide(self, scores: list[float], script: int, letters: int, evidence: float) -> tuple[str, float, int]:
        """Family, then language by the votes of its pairs."""
        if not letters:
            return "und", 0.0, 0
        able = self.writers[script] or range(len(self.families))
        if len(able) == 1 and len(self.members[self.families[able[0]]]) == 1:
            return self.members[self.families[able[0]]][0], 1.0 - 0.5**letters, letters
        ranked = sorted(((scores[k], k) for k in able), reverse=True)
        k = ranked[0][1]
        conf = _sure(evidence * (ranked[0][0] - ranked[1][0])) if len(ranked) > 1 else 1.0
        langs = self.members[self.families[k]]
        if len(langs) == 1:
            return langs[0], conf, letters
        votes, margin = dict.fromkeys(langs, 0), dict.fromkeys(langs, math.inf)
        for a, b in combinations(langs, 2):
            m = scores[self.place[a, b]]
            votes[a if m >= 0 else b] += 1
            margin[a], margin[b] = min(margin[a], m), min(margin[b], -m)
        best = max(langs, key=lambda x: (votes[x], margin[x], x))
        return best, conf * _sure(evidence * margin[best]), letters


#: Judgements remembered in a process, by model and sentence; emptied when many.
_JUDGED: dict[int, dict[str, tuple[str, float, int]]] = {}


def _sure(margin: float) -> float:
    return 1.0 / (1.0 + math.exp(-4.0 * max(min(margin, 50.0), -50.0)))


def fit(texts: list[str], labels: list[str], stands_for: dict[str, float] | None = None, per_language: int = 4 * SAMPLE_PER_LANGUAGE) -> Model:
    """Model from labelled texts, learnt from their sentences.

    A sentence that comes under several labels counts under the one of whose
    sentences it is the greatest part, unless that is one sixth of its rows or less;
    ``stands_for`` says how many rows one sampled row of a label stands for; of each language ``per_language`` sentences are taken, frequent ones first
    and equally frequent ones in hash order; a sentence weighs as often as it occurs,
    up to ``MOST_WEIGHT``. The
    second pass leaves out what the first puts elsewhere than labelled, since
    labels are dirty and texts mix languages. Repeatable: the order of the rows
    doesn't matter.
    """
    votes: dict[str, dict[str, float]] = {}
    rate = stands_for or {}
    for t, lab in zip(texts, labels):
        a, one = 0, rate.get(lab, 1.0)
        for b in sentence_ends(t):
            s = t[a:b].strip()
            a = b
            if len(_LETTER.findall(s)) >= TRAIN_LETTERS:
                v = votes.setdefault(s, {})
                v[lab] = v.get(lab, 0.0) + one
    total: dict[str, float] = {}
    for v in votes.values():
        for lab, n in v.items():
            total[lab] = total.get(lab, 0.0) + n
    by_label: dict[str, list[tuple[float, int, str]]] = {}
    for s, v in votes.items():
        often = min(sum(n / rate.get(k, 1.0) for k, n in v.items()), MOST_WEIGHT)
        # A label that stands for "unknown" comes with everything, so what counts is
        # how much of a label's sentences this one is; rare slips don't.
        fair = {k: n for k, n in v.items() if 6 * n >= sum(v.values())}
        by_label.setdefault(max(fair, key=lambda k: (fair[k] / total[k], k)), []).append((-often, zlib.crc32(s.encode("utf-8", "surrogatepass")), s))
    rows, weight = [], []
    for lab in sorted(by_label):
        for often, _, s in sorted(by_label[lab])[:per_language]:
            rows.append((lab, s))
            weight.append(float(-often))
    labels_of = [lab for lab, _ in rows]
    x = [features(s) for _, s in rows]
    model = _fit(x, labels_of, weight)
    kept = [i for i, (got, (lab, _)) in enumerate(zip(model.judge_all([s for _, s in rows]), rows)) if got[0] == lab]
    counts: dict[str, int] = {}
    for i in kept:
        counts[labels_of[i]] = counts.get(labels_of[i], 0) + 1
    kept = [i for i in kept if counts[labels_of[i]] >= 3]
    return _fit([x[i] for i in kept], [labels_of[i] for i in kept], [weight[i] for i in kept]) if kept else model


def _fit(x: list[Row], labels: list[str], weights: list[float]) -> Model:
    weight = np.array(weights)
    fam_of = [FAMILY_OF.get(lab, lab) for lab in labels]
    langs, fams = np.array(labels), np.array(fam_of)
    families = sorted(set(fam_of))
    w = np.array([_train_svm(x, np.where(fams == f, 1.0, -1.0), weight) for f in families]) if len(families) > 1 else np.zeros((1, DIMENSION + RESERVED))
    members = {f: sorted({lab for lab, g in zip(labels, fam_of) if g == f}) for f in families}
    pairs = {}
    for f in families:
        for a, b in combinations(members[f], 2):
            pick = np.flatnonzero((langs == a) | (langs == b))
            pairs[a, b] = _train_svm([x[i] for i in pick], np.where(langs[pick] == a, 1.0, -1.0), weight[pick])
    scripts = np.array([np.mean([v[: len(_SCRIPTS)] for (_, v), g in zip(x, fam_of) if g == f], axis=0) for f in families])
    return Model(families, w, members, pairs, scripts)


def train(labelled: DataFrame, text: str, label: str, per_language: int = SAMPLE_PER_LANGUAGE, signs: tuple[int, int] = TRAIN_SIGNS) -> Model:
    """Model from a sample of ``labelled`` with about ``per_language`` rows of each
    label, drawn evenly by the hash of the text; at most twice as many rows times
    the number of labels, the first in the order of that hash, each of ``signs`` code
    points, reach the driver, so equal tables give equal models. Rows with null text or
    without a language in the label are left out of the sample.
    """
    need(labelled, text, label)
    rows = labelled.select(F.col(text).alias("t"), label_code(F.col(label)).alias("l")).where(
        F.col("l").isNotNull() & F.char_length("t").between(*signs)
    )
    rows = rows.withColumn("h", F.abs(F.xxhash64("t")) % 1_000_000)
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    counts = {k: v for k, v in counts.items() if v >= 3}
    if not counts:
        raise ValueError("no labelled rows to learn languages from")
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1_000_000, math.ceil(1_000_000 * per_language / n)))])
    sample = rows.where(F.col("h") < F.coalesce(share[F.col("l")], F.lit(0)))
    got = sample.orderBy("h", "l", "t").select("l", "t").limit(2 * per_language * len(counts)).collect()
    stands_for = {lang: max(1.0, n / per_language) for lang, n in counts.items()}
    return fit([readable(r["t"]) for r in got], [r["l"] for r in got], stands_for)


SEGMENT = ArrayType(StructType([
    StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("lang", StringType()),
    StructField("confidence", DoubleType()), StructField("letters", IntegerType()),
]))


def segments_udf(model: Model):
    """Sentences of a text with language, confidence and number of letters."""
    @F.pandas_udf(SEGMENT)
    def run(text: pd.Series) -> pd.Series:
        known = _JUDGED.setdefault(model.stamp, {})
        if len(known) > 200_000:
            known.clear()
        cut: list[list[tuple[int, int, str]] | None] = []
        for t in text:
            if t is None:
                cut.append(None)
                continue
            a, rows = 0, []
            for b in sentence_ends(t):
                rows.append((a, b, readable(t[a:b])))
                a = b
            cut.append(rows)
        new = list({s: None for rows in cut for _, _, s in rows or () if s not in known})
        known.update(zip(new, model.judge_all(new)))
        return pd.Series([None if rows is None else [(a, b, *known[s]) for a, b, s in rows] for rows in cut], dtype=object)

    # Not deterministic for the optimizer, lest it classifies once more for a filter.
    return run.asNondeterministic()


def language_segments(docs: DataFrame, model: Model, key: list[str], text: str = "text") -> DataFrame:
    """``(*key, start, end, lang, confidence, letters)`` for every sentence of
    ``docs``; null and empty texts give no row, a sentence without letters the
    language ``und`` with confidence 0. No shuffle but to spread the work."""
    need(docs, *key, text)
    cut = docs.select(*key, segments_udf(model)(F.col(text)).alias("__s"))
    return cut.select(*key, F.explode("__s").alias("s")).select(*key, "s.*")


def main_language(segments: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``(doc, lang, confidence, share)``: the language of most letters of each
    document, its letter-weighted confidence and share; ties go to the code that
    sorts first. Letters are summed map-side before the shuffle, so a large
    document moves few rows."""
    per = segments.where(F.col("lang") != "und").groupBy(doc, "lang").agg(
        F.sum("letters").alias("n"), F.sum(F.col("letters") * F.col("confidence")).alias("c")
    )
    return per.groupBy(doc).agg(
        F.min_by("lang", F.struct(-F.col("n"), F.col("lang"))).alias("lang"),
        F.min_by(F.col("c") / F.col("n"), F.struct(-F.col("n"), F.col("lang"))).alias("confidence"),
        (F.max("n") / F.sum("n")).alias("share"),
    )


def filing_segments(paragraphs: DataFrame, model: Model) -> DataFrame:
    """Segments of the marked-up paragraphs, each row of them once."""
    need(paragraphs, "para_id", "doc_id", "side", "text")
    rows = paragraphs.where((F.col("side") == "sgml") & F.col("text").isNotNull()).select("para_id", "doc_id", "text")
    # Few bytes are much work here, so the partitions of the one shuffle are fixed.
    rows = rows.repartition(parts_of(rows.sparkSession), "para_id").dropDuplicates(["para_id"])
    return language_segments(rows, model, ["para_id", "doc_id"])


def foreign_segments(segments: DataFrame, mains: DataFrame) -> DataFrame:
    """Every segment in another language than its document's, with the confidence and
    the document's language as ``main_lang``; those without letters are in none."""
    m = mains.select("doc_id", F.col("lang").alias("main_lang"))
    return segments.join(m, "doc_id").where((F.col("lang") != "und") & (F.col("lang") != F.col("main_lang")))


def certain(foreign: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """Foreign segments with at least this confidence, and those of two and more
    letters whose language is written in another script than the main one: they can't
    be in the main language, whichever other one they are in."""
    script = F.create_map(*[F.lit(x) for lang, fam in FAMILY_OF.items() for x in (lang, "latin" if fam in LATIN_FAMILIES else fam)])
    other = F.try_element_at(script, F.col("lang")) != F.try_element_at(script, F.col("main_lang"))
    return foreign.where((F.col("confidence") >= least) | other & (F.col("letters") >= 2))


def wrong_labels(tables: dict[str, tuple[DataFrame, str]], mains: DataFrame) -> DataFrame:
    """``(unit, unit_id, lang)``: documents of each table (name to rows and label
    column) whose label is missing, names no language or another than the main
    one. Rows resent with the same id count once; if they disagree, one wrong
    label is enough."""
    out = None
    m = mains.select("doc_id", "lang")
    for unit, (rows, label) in tables.items():
        need(rows, "doc_id", label)
        bad = (
            rows.select("doc_id", label_code(F.col(label)).alias("said")).dropDuplicates()
            .join(m, "doc_id").where(~F.col("said").eqNullSafe(F.col("lang")))
            .select(F.lit(unit).alias("unit"), F.col("doc_id").alias("unit_id"), "lang").dropDuplicates(["unit_id"])
        )
        out = bad if out is None else out.unionByName(bad)
    return out

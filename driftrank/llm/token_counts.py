"""Token counts of whole texts through a digest cache.

A text's digest is taken of its normal form, a rewriting that can't change its count: where the tokenizer file itself folds
case and white space, runs of white space count as one space and, in texts of ASCII characters alone, A-Z as a-z; texts in
which a special string of the file could appear are digested as they are. A tokenizer's version is the digest of its file
and of the library that reads it, so another file or library never reads these counts.

The cache is a Parquet table (version, digest, n_tokens) in a folder of its own, added to by whole runs: digests that it
lacks are written down first, one text of each is encoded, and what that gives is appended. Only digests meet the rows;
texts are shuffled once, one of each digest a map task, and only for what has to be encoded. Two runs at a time may store a
digest twice, with the same count; a run that fails leaves nothing behind.

Defined results: null and empty texts have no tokens; texts of any length are encoded whole; repeated rows give repeated
results; an empty table gives an empty result; extra columns are ignored. Texts with equal 256-bit digests are taken as equal, words
with equal 64-bit hashes too.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftrank.llm.textkit import slices, splitmix, utf8
from driftrank.tables import park, shared_dir

#: Misses are broadcast only up to so many digests (32 bytes each).
BROADCAST_MISSES = 100_000
MEMO_WORDS = 1_000_000
_CACHE = "version string, digest binary, n_tokens long"
#: The word pattern and the normaliser of the files that `FoldedBpe` reads.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALISER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]

U = np.uint64
SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
LONGEST = 64  # bytes of a word that is merged here; longer ones go to the library
NEVER = np.int64(1) << 60


def _classes() -> np.ndarray:
    """What each code point below 256 is to the word pattern."""
    out = np.full(256, OTHER, np.int8)
    for c in map(chr, range(256)):
        if c.isalpha():
            out[ord(c)] = LETTER
        elif c.isnumeric():
            out[ord(c)] = DIGIT
    out[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = SPACE
    return out


_CLASS = _classes()
#: By byte: ASCII letters, and the second bytes of two-byte letters after 0xC3, lower-cased.
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_LOW_C3 = np.arange(256, dtype=np.uint8)
_LOW_C3[[b for b in range(0x80, 0x9F) if b != 0x97]] += 32
_MIX = splitmix(np.arange(LONGEST * 256, dtype=U)).reshape(LONGEST, 256)


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends) of the pattern's words in texts of code points below 256.

    A word is a maximal run of letters or of other characters, or one digit; an apostrophe that is a run of its own takes
    the letters of a contraction with it.
    """
    raw = raw.copy()
    lead = raw >= 0xC2
    tail = np.zeros(len(raw), bool)
    tail[1:] = lead[:-1]
    point = raw.astype(np.int16)
    at = np.flatnonzero(lead)
    point[at] = ((raw[at] & 3).astype(np.int16) << 6) | (raw[at + 1] & 63)
    kind = _CLASS[np.minimum(point, 255)]
    upper = at[raw[at] == 0xC3] + 1
    raw = np.where(tail, raw, _LOW[raw])
    raw[upper] = _LOW_C3[raw[upper]]
    kind[at + 1] = kind[at]
    head = np.ones(len(raw), bool)
    head[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    inner = off[1:-1]
    head[inner[inner < len(raw)]] = True
    head[tail] = False
    # Contractions: "'" alone, then letters.
    text_of_next = np.zeros(len(raw) + 4, bool)
    text_of_next[inner] = True
    quote = np.flatnonzero((raw == 0x27) & head)
    quote = quote[quote + 1 < len(raw)]
    quote = quote[(kind[quote + 1] == LETTER) & ~text_of_next[quote + 1]]
    padded = np.concatenate([raw, np.zeros(4, np.uint8)])
    a, b = padded[quote + 1], padded[quote + 2]
    one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
    two = ((a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & ~text_of_next[quote + 2]
    size = np.where(one, 2, np.where(two, 3, 0))
    quote, size = quote[size > 0], size[size > 0]
    head[quote + 1] = False
    after = quote + size
    head[after[after < len(raw)]] = True
    start = np.flatnonzero(head)
    end = np.append(start[1:], len(raw))
    keep = kind[start] != SPACE
    return raw, start[keep], end[keep]


class FoldedBpe:
    """Counts the tokens of a file whose normaliser folds case and white space and whose pieces mark word ends.

    Texts of code points below 256 are cut into words and merged here, a whole batch of distinct words at once; other texts,
    and texts that hold an added token, go to the library.
    """

    def __init__(self, whole: dict, library: Library) -> None:
        model = whole["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        alphabet = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        self.first = np.array([vocab[alphabet[b]] for b in range(256)] + [vocab[alphabet[b] + suffix] for b in range(256)], np.int64)
        self.base = len(vocab)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.key, self.rank, self.made = key[order], order.astype(np.int64), made[order]
        self.library = library
        self.added = [t["content"] for t in whole.get("added_tokens") or ()]
        self.known, self.count = np.zeros(0, U), np.zeros(0, np.int64)

    @staticmethod
    def reads(whole: dict) -> bool:
        """Whether the file is of the kind that the vectorised path expresses."""
        model, norm, pre = whole.get("model") or {}, whole.get("normalizer") or {}, whole.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers") or [{}, {}]
        return (
            model.get("type") == "BPE" and bool(model.get("end_of_word_suffix")) and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            and norm.get("normalizers") == _NORMALISER and len(steps) == 2
            and steps[0].get("pattern") == {"Regex": _WORD_PATTERN} and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True
            and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
            and not any(t.get("normalized") for t in whole.get("added_tokens") or ())
        )

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of pairs of symbols; NEVER where they don't merge."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = self.key[at] == key
        return np.where(hit, self.rank[at], NEVER), self.made[at]

    def merged(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Tokens of each word after merging: always a word's best-ranked pair, the leftmost of equals.

        symbols: those of all words in a row; first: where each word begins. Words none of whose pairs merges leave the arrays.
        """
        n_words = len(first)
        out = np.zeros(n_words, np.int64)
        word = np.repeat(np.arange(n_words), np.diff(np.append(first, len(symbols))))
        label = np.arange(n_words)
        rank, made = np.full(len(symbols), NEVER), np.zeros(len(symbols), np.int64)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside], made[inside] = self._ranks(symbols[inside], symbols[inside + 1])
        while len(symbols):
            place = np.arange(len(symbols)) - first[word]
            best = np.minimum.reduceat(np.where(rank < NEVER, rank * (LONGEST + 1) + place, NEVER), first)
            open_ = best < NEVER
            if not open_.all():
                size = np.diff(np.append(first, len(symbols)))
                out[label[~open_]] = size[~open_]
                stay = open_[word]
                symbols, rank, made = symbols[stay], rank[stay], made[stay]
                best, label, size = best[open_], label[open_], size[open_]
                if not len(label):
                    break
                first = np.concatenate([[0], np.cumsum(size)[:-1]])
                word = np.repeat(np.arange(len(label)), size)
            at = first + best % (LONGEST + 1)
            symbols[at] = made[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            shift = np.cumsum(keep) - 1
            symbols, word, rank, made = symbols[keep], word[keep], rank[keep], made[keep]
            first, at = shift[first], shift[at]
            for i in (at, at[at > first] - 1):
                last = np.append(word, -1)[i + 1] != word[i]
                r, m = self._ranks(symbols[i], symbols[np.minimum(i + 1, len(symbols) - 1)])
                rank[i], made[i] = np.where(last, NEVER, r), m
        return out

    def _words(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each word, through a bounded memo of hashes of words."""
        size = end - start
        out = np.zeros(len(start), np.int64)
        long = np.flatnonzero(size > LONGEST)
        if len(long):
            out[long] = self.library.counts([raw[a:b].tobytes().decode() for a, b in zip(start[long], end[long])])
        short = np.flatnonzero(size <= LONGEST)
        if not len(short):
            return out
        start, size = start[short], size[short]
        lead = np.concatenate([[0], np.cumsum(size)[:-1]])
        deep = np.arange(int(size.sum())) - np.repeat(lead, size)
        place = np.repeat(start, size) + deep
        h = splitmix(np.add.reduceat(_MIX[deep, raw[place]], lead) + size.astype(U))
        distinct, one, back = np.unique(h, return_index=True, return_inverse=True)
        n = np.zeros(len(distinct), np.int64)
        at = np.searchsorted(self.known, distinct)
        hit = np.zeros(len(distinct), bool)
        if len(self.known):
            hit = self.known[np.minimum(at, len(self.known) - 1)] == distinct
            n[hit] = self.count[at[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            w = one[new]
            sizes = size[w]
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            at_ = np.repeat(start[w] - first, sizes) + np.arange(int(sizes.sum()))
            symbols = raw[at_].astype(np.int64)
            symbols[first + sizes - 1] += 256
            n[new] = self.merged(self.first[symbols], first)
            if len(self.known) + len(new) > MEMO_WORDS:
                self.known, self.count = self.known[:0], self.count[:0]
            known, count = np.concatenate([self.known, distinct[new]]), np.concatenate([self.count, n[new]])
            order = np.argsort(known, kind="stable")
            self.known, self.count = known[order], count[order]
        out[short] = n[back]
        return out

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        plain, other = [], []
        for i, t in enumerate(texts):
            odd = any(a in t for a in self.added) or not t.isascii() and (max(t) > "\xff" or any(c in t for c in _UNSURE))
            (other if odd else plain).append(i)
        for i, n in zip(other, self.library.counts([texts[i] for i in other])):
            out[i] = n
        if plain:
            raw, off = utf8(pa.array([texts[i] for i in plain], pa.large_string()))
            if len(raw):
                raw, start, end = word_spans(raw, off)
                total = np.concatenate([[0], np.cumsum(self._words(raw, start, end))])
                edge = np.searchsorted(start, off)
                for i, n in zip(plain, (total[edge[1:]] - total[edge[:-1]]).tolist()):
                    out[i] = n
        return out


#: Code points below 256 that are white space, controls or signs of unsure class; texts with one go to the library.
_UNSURE = [chr(c) for c in (*range(0x80, 0xA1), 0xAD, 0xAA, 0xBA, 0xB5)]


class Library:
    """Counts by the library that reads the file."""

    def __init__(self, path: str) -> None:
        self.pieces = path.endswith(".model")
        if self.pieces:
            import sentencepiece

            self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            self.own = Tokenizer.from_file(path)
            self.own.no_truncation()
            self.own.no_padding()

    def counts(self, texts: list[str]) -> list[int]:
        if self.pieces:
            return [len(ids) for ids in self.own.encode(texts, num_threads=1)] if texts else []
        return [len(self.own.encode(t, add_special_tokens=False).ids) for t in texts]


def _file(path: str) -> dict:
    if path.endswith(".model"):
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@lru_cache(maxsize=2)
def load(path: str) -> Library | FoldedBpe:
    library, whole = Library(path), _file(path)
    return FoldedBpe(whole, library) if FoldedBpe.reads(whole) else library


def version(path: str) -> str:
    """Digest of the tokenizer file and of the library that reads it."""
    import importlib.metadata as meta

    with open(path, "rb") as f:
        raw = f.read()
    name = "sentencepiece" if path.endswith(".model") else "tokenizers"
    return hashlib.sha256(f"{name} {meta.version(name)} {hashlib.sha256(raw).hexdigest()}".encode()).hexdigest()


def digest(text: Column, path: str) -> Column:
    """The 32-byte digest of the text's normal form under the file's own folding."""
    whole = _file(path)
    if not FoldedBpe.reads(whole):
        return F.unhex(F.sha2(text.cast("binary"), 256))
    spaced = F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))
    plain = F.when(F.octet_length(text) == F.char_length(text), F.lower(spaced)).otherwise(spaced)
    special = F.lit(False)
    for t in whole.get("added_tokens") or ():
        special = special | F.lower(text).contains(t["content"].lower())
    return F.unhex(F.sha2(F.when(special, text).otherwise(plain).cast("binary"), 256))


def stored(spark: SparkSession, cache: str, tokenizer_version: str) -> DataFrame:
    """(digest, n_tokens) of one version, each digest once; empty where there is no cache yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    rows = spark.read.schema(_CACHE).parquet(cache).where(F.col("version") == tokenizer_version)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row. `cache`: a folder that driver and executors share; without one a new
    cache is begun, so that nothing is known beforehand."""
    spark = docs.sparkSession
    cache = cache or f"{shared_dir(spark)}/driftrank/token-counts-{uuid.uuid4().hex}"
    v = version(path)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", digest(F.col("text"), path))
    keyed = park(texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "digests")
    digests = park(keyed.select("digest").distinct(), "distinct-digests")
    misses = park(digests.join(stored(spark, cache, v), "digest", "left_anti"), "misses")
    n = misses.count()
    if n:
        held = texts.select("digest", "text")
        if n <= BROADCAST_MISSES:
            one = held.join(F.broadcast(misses), "digest", "left_semi").dropDuplicates(["digest"])
        else:
            one = held.dropDuplicates(["digest"]).join(misses, "digest", "left_semi")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = load(path)
            for batch in batches:
                for part in slices(batch):
                    counts = pa.array(model.counts(part.column("text").to_pylist()), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([v] * part.num_rows), part.column("digest"), counts], ["version", "digest", "n_tokens"])

        one.mapInArrow(run, _CACHE).write.mode("append").option("compression", "zstd").parquet(cache)
    # Both sides of the last join are tables as written, so that Spark can split a digest with very many rows.
    counts = park(digests.join(stored(spark, cache, v), "digest"), "counts")
    out = keyed.join(counts, "digest", "left")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

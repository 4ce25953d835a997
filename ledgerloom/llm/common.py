"""What the operators share: words, hashes, tokenizers and tables in the shared folder."""

from __future__ import annotations

import ctypes
import json
import os
import re
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
WORD_BYTES_RE = re.compile(rb"[^\x20\x09-\x0D]+")
ASCII_SPACE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a driver that runs its tasks itself may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return "/tmp/ledgerloom-shared"


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder and read back: cuts lineage, outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (made := _made.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of whatever store Spark writes to."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that were stored within it; what was made of them has to be written by then."""
    token = _made.set(made := [])
    try:
        yield
    finally:
        _made.reset(token)
        for path in made:
            removed(spark, path)


#: A key is hot if it holds over 1 / HOT of the rows; so fewer than HOT keys are.
HOT = 1024


def hot_keys(rows: DataFrame, on: str, least: int | None = None) -> DataFrame | None:
    """The hot values of a column, fewer than HOT rows, or None without any; rows should be a stored table, as they are
    read twice. The values are a table and no literals, so that plans stay small."""
    least = max(1, rows.count() // HOT) if least is None else least
    counts = rows.groupBy(on).agg(F.count("*").alias("n")).where((F.col("n") > least) & F.col(on).isNotNull())
    return hot_table(counts, on)


def hot_table(values: DataFrame, on: str) -> DataFrame | None:
    """Fewer than HOT values as a table of their own."""
    found = values.select(on).toArrow()
    return values.sparkSession.createDataFrame(found).withColumn("_hot", F.lit(True)) if found.num_rows else None


def spread_join(left: DataFrame, right: DataFrame, on: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """left joined with right, which has each value once: rows of hot values stay where they are and meet a broadcast of
    right's rows for them, fewer than HOT; the rest are dealt by the value."""
    if hot is None:
        return left.join(right, on, how)
    marked = left.join(F.broadcast(hot), on, "left")
    warm = marked.where(F.col("_hot")).drop("_hot").join(F.broadcast(right.join(F.broadcast(hot.select(on)), on, "left_semi")), on, how)
    return warm.unionByName(marked.where(F.col("_hot").isNull()).drop("_hot").join(right, on, how))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class WordHashes(dict):
    """64-bit hashes of words (bytes), kept up to a number of words."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.LIMIT:
            self[word] = value
        return value


WORD_HASHES = WordHashes()


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: White space that str.split() divides words at, besides the six characters.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def ascii_words(text: str) -> list[str]:
    return WORD_RE.findall(text) if OTHER_SPACE.search(text) else text.split()


def lower_latin(text: str) -> str:
    """Lower case of texts below U+0100, where it goes letter by letter and composition changes nothing; others as they are."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
    return text.lower()


def encodes_words_alone(spec: dict) -> bool:
    """Whether a tokenizer's normalizer (composition, white space to blanks, lower case) and pre-tokenizer (only what its
    pattern matches, and that matches no white space) let the words between white space encode each on its own."""
    parts = (spec.get("normalizer") or {}).get("normalizers") or []
    kinds = [p.get("type") for p in parts]
    cutters = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    if kinds != ["NFC", "Replace", "Lowercase"] or parts[1].get("pattern") != {"Regex": "\\s+"} or not cutters:
        return False
    cutter = cutters[0]
    if (cutter.get("type"), cutter.get("behavior"), cutter.get("invert")) != ("Split", "Removed", True) or any(c.get("add_prefix_space") for c in cutters):
        return False
    pattern = regex.compile(cutter["pattern"].get("Regex", r"\s"))
    return not any(regex.search(r"\s", m[0]) for m in pattern.finditer(" a 1 . \ta\nb\x0b\x0c\r.\x1c \x85\xa0. \u2003a\u3000"))


class WordEncoder:
    """A tokenizer, quick where words between ASCII white space encode on their own; with others texts are encoded whole.

    Up to LIMIT words of up to LONGEST characters are kept with their ids, each from the second batch on that holds it
    (as far as a table of 2**MET_BITS marks can tell), as most words come once. The other words of a batch go to the library as a few texts, parted by a mark that is a token of its
    own; words with the mark go there alone, and texts that hold an added token whole. Latin texts are put into lower case first, as the normalizer does.
    """

    LIMIT, LONGEST, MET_BITS, MARKS = 500_000, 64, 23, "@~^"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.wordwise = encodes_words_alone(json.loads(self.library.to_str()))
        self.special = sorted({t.content for t in self.library.get_added_tokens_decoder().values()})
        #: Ids are kept and joined as bytes.
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.mark = next((m for m in self.MARKS if len(self._whole(m)) == self.dtype.itemsize), None)
        self.known: dict[str, bytes] = {}
        self.met = bytearray(1 << self.MET_BITS)

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _encoded(self, words: list[str], together: int = 50) -> Iterator[tuple[str, bytes]]:
        plain = [w for w in words if self.mark is not None and self.mark not in w]
        yield from ((w, self._whole(w)) for w in words if self.mark is None or self.mark in w)
        groups = [plain[k : k + together] for k in range(0, len(plain), together)]
        between, size = f" {self.mark} ", self.dtype.itemsize
        cut = np.frombuffer(self._whole(self.mark), self.dtype)[0] if groups else 0
        for group, e in zip(groups, self.library.encode_batch_fast([between.join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            flat, ends = ids.tobytes(), [*(np.flatnonzero(ids == cut) * size).tolist(), len(ids) * size]
            at = 0
            for w, end in zip(group, ends, strict=True):
                yield w, flat[at:end]
                at = end + size

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without added tokens."""
        if not self.wordwise:
            return [np.array(e.ids, self.dtype) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        known, special, met, mask = self.known, self.special, self.met, len(self.met) - 1
        get, new, rows = known.get, set(), []
        for t in texts:
            if any(s in t for s in special):
                rows.append(([self._whole(t)], (), ()))
                continue
            words = ascii_words(lower_latin(t))
            parts = list(map(get, words))
            holes = [i for i, p in enumerate(parts) if p is None] if None in parts else ()
            new.update([words[i] for i in holes])
            rows.append((parts, words, holes))
        fresh = dict(self._encoded(list(new)))
        for w, ids in fresh.items():
            if met[place := hash(w) & mask] and len(known) < self.LIMIT and len(w) <= self.LONGEST:
                known[w] = ids
            met[place] = 1
        out = []
        for parts, words, holes in rows:
            for i in holes:
                parts[i] = fresh[words[i]]
            out.append(np.frombuffer(b"".join(parts), self.dtype))
        return out

    def __call__(self, text: str) -> list[int]:
        return self.batch([text])[0].tolist()


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def bounded(spark: SparkSession) -> None:
    """Arrow batches of some megabytes, so that texts take little memory beside the heap."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")


#: How numpy's builds of OpenBLAS name the call.
SET_THREADS = ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads")


@lru_cache(maxsize=1)
def one_thread() -> None:
    """Matrix products of this worker on one thread: a task has one core, and more threads only wait for one another."""
    for path in Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in SET_THREADS:
            if hasattr(library, name):
                getattr(library, name)(1)
                return


def trimmed() -> None:
    """Gives the system back what this process has freed, as models of earlier tasks or steps; glibc's part only there."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process."""
    return WordEncoder(path)

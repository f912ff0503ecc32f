"""Token counts and token ids with the vocabularies of public tokenizers."""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import staged

#: Pre-tokens whose piece counts are sent to every task; the rest meet their counts in a join.
HEAD = 200_000
#: Longest pre-token in that head, so that its size has a bound (HEAD * HEAD_CHARS * 4 bytes).
HEAD_CHARS = 32
#: Distinct pre-tokens that a task holds before it hands its counts on.
FLUSH = 400_000

# The letters and numbers of Unicode below U+0250, and the pre-token pattern of the
# lower-case vocabulary over them. A text with any other letter, number, mark or white space gets its
# pre-tokens from the library itself.
LATIN_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
LATIN_NUMBERS = "0-9²³¹¼-¾"
OUTSIDE = re.compile("[^\t-\r -~¡-ɏ‐-‧]")
WORD_PRETOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN_LETTERS}]+|[{LATIN_NUMBERS}]|[^\s{LATIN_LETTERS}{LATIN_NUMBERS}]+")
SPECIALS = ("<|startoftext|>", "<|endoftext|>")


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def plain(text: str) -> bool:
    """Whether the pre-tokens of a text can be told by the Latin patterns alone."""
    return "<|" not in text and (text.isascii() and not re.search("[\x00-\x08\x0e-\x1f\x7f]", text) or not OUTSIDE.search(text) and "İ" not in text)


def word_pretokens(text: str) -> list[str]:
    return WORD_PRETOKEN.findall(text.lower())


def library_pretokens(tokenizer, text: str) -> list[str]:
    """The pre-tokens of any text, by the library's own normaliser and pre-tokeniser."""
    return [w for w, _ in tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(text))]


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    for b in batches:
        yield b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]


def token_counts(docs: DataFrame, path: str, limit: int = 2048, head: int = HEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text, as the library counts them, without materialising their ids.

    Pre-tokens are counted over the corpus; each distinct one is cut into pieces once. A document's
    count is the sum over its distinct pre-tokens of frequency times pieces. The ``head`` most
    frequent pre-tokens are sent to all tasks (their number and length are bounded) and summed where the
    document is read; the frequencies of all others are joined to the dictionary by pre-token.

    Texts with characters beyond Latin script get their pre-tokens from the library and are counted the same way;
    only texts with special strings are counted by the library as a whole. A null or empty text has 0 tokens; repeated rows and null ids give a row each;
    other columns are not read; an empty table gives an empty result.

    Returns id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def pretoken_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        tokenizer = load_tokenizer(path)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["pretoken", "freq"])

        for _, chunk in _columns(batches):
            for text in chunk:
                if plain(text):
                    seen.update(word_pretokens(text))
                elif not any(x in text for x in SPECIALS):
                    seen.update(library_pretokens(tokenizer, text))
            if len(seen) > FLUSH:
                yield out()
                seen.clear()
        yield out()

    def piece_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(path)
        for b in batches:
            pieces = [len(e.ids) for e in tokenizer.encode_batch_fast(b.column(0).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pieces, pa.int32())], ["pretoken", "freq", "pieces"])

    found = texts.mapInArrow(pretoken_counts, "pretoken string, freq long").groupBy("pretoken").agg(F.sum("freq").alias("freq"))
    dictionary = staged(found.mapInArrow(piece_counts, "pretoken string, freq long, pieces int"), "pieces")
    # the head: pre-tokens above the frequency that leaves at most ``head``, found from counts by steps of frequency
    short = dictionary.filter(F.length("pretoken") <= HEAD_CHARS).withColumn("step", F.floor(F.log2("freq") * 8).cast("int"))
    cut, held = 1 << 20, 0
    for r in sorted(short.groupBy("step").count().collect(), key=lambda r: -r["step"]):
        held += r["count"]
        if held > head:
            break
        cut = r["step"]
    common = short.filter(F.col("step") >= cut)
    known = spark.sparkContext.broadcast(dict(common.select("pretoken", "pieces").toPandas().itertuples(index=False, name=None)))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer = load_tokenizer(path)
        get = known.value.get
        row = TaskContext.get().partitionId() << 40
        for ids, chunk in _columns(batches):
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for i, text in zip(ids, chunk, strict=True):
                row += 1
                total, rest = 0, Counter()
                if not any(x in text for x in SPECIALS):
                    for word, n in Counter(word_pretokens(text) if plain(text) else library_pretokens(tokenizer, text)).items():
                        pieces = get(word)
                        if pieces is None:
                            rest[word] = n
                        else:
                            total += n * pieces
                else:
                    total = len(tokenizer.encode(text, add_special_tokens=False).ids)
                for values in [(row, i, len(text.encode()), total, None, None), *((row, None, None, None, w, n) for w, n in rest.items())]:
                    for c, v in zip(cols, values, strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    names = ["row", "id", "n_bytes", "total", "pretoken", "freq"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32()]
    per = staged(texts.withColumn("id", F.col("id").cast("long")).mapInArrow(frequencies, "row long, id long, n_bytes long, total long, pretoken string, freq int"), "frequencies")
    heads = per.filter("pretoken is null").select("row", "id", "n_bytes", "total")
    tails = per.filter("pretoken is not null").select("row", "pretoken", "freq").join(dictionary.select("pretoken", "pieces"), "pretoken")
    tails = tails.groupBy("row").agg(F.sum(F.col("freq").cast("long") * F.col("pieces")).alias("tail"))
    n = (F.col("total") + F.coalesce("tail", F.lit(0))).cast("long")
    return heads.join(tails, "row", "left").select(F.col("id").alias(id_col), "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))


#: White space that may stand beside a single space, which then isn't the start of a pre-token.
DOUBLED = ("  ", *(x for w in "\t\n\v\f\r" for x in (f" {w}", f"{w} ")))
#: Stretches that are encoded as one text.
TOGETHER = 2000


class ByteIds:
    """Ids of whole texts under the byte-level vocabulary, as little-endian unsigned 32-bit bytes.

    A stretch from one single space before a word to the next is cut into pre-tokens the same way
    wherever it stands, so its ids are remembered. ``tokenizers`` gives them, for many stretches in one
    text: the ids of a stretch begin with the one token that begins with a space. Texts with doubled
    white space, special strings or characters beyond Latin script go through it as a whole.
    """

    def __init__(self, path: str, most: int = 600_000) -> None:
        self.tokenizer, self.known, self.most = load_tokenizer(path), {}, most
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        return (np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))

    def whole(self, text: str) -> bytes:
        return next(self.ids([text])).tobytes()

    def learn(self, stretches: list[str]) -> None:
        known, firsts = self.known, [w for w in stretches if w[:1] != " "]
        rest = [w for w in stretches if w[:1] == " "]
        groups = [rest[at : at + TOGETHER] for at in range(0, len(rest), TOGETHER)]
        for group, ids in zip(groups, self.ids(["".join(g) for g in groups]), strict=True):
            at = np.append(np.flatnonzero(self.spaced[ids]), len(ids))
            if len(at) != len(group) + 1:
                firsts += group
                continue
            data, at = ids.tobytes(), (at * 4).tolist()
            for w, a, b in zip(group, at, at[1:], strict=False):
                known[w] = data[a:b]
        for w, ids in zip(firsts, self.ids(firsts), strict=True):
            known[w] = ids.tobytes()

    def batch(self, texts: list[str]) -> list[bytes]:
        known, cut, missing = self.known, [], set()
        if len(known) > self.most:
            known.clear()
        for text in texts:
            if not plain(text) or text[:1] == " " or text[-1:] == " " or any(x in text for x in DOUBLED):
                cut.append(None)
                continue
            words = text.replace(" ", "\x00 ").split("\x00")
            cut.append(words)
            missing.update(w for w in words if w not in known)
        self.learn(list(missing))
        return [self.whole(t) if c is None else b"".join(map(known.__getitem__, c)) for t, c in zip(texts, cut, strict=True)]


_encoders: dict[str, ByteIds] = {}


def byte_ids(path: str) -> ByteIds:
    """The encoder of this worker process, with what it remembers from earlier tasks."""
    if path not in _encoders:
        _encoders[path] = ByteIds(path)
    return _encoders[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_counts(spark, sf_dir):
    """Token counts of all documents; see ``token_counts``."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("word_bpe_49k.json"))

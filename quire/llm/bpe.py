"""BPE encoding and decoding through a table of distinct words.

1. Words are a space and what follows it, or a run of white space; tokens never cross them, nor the place between a
   letter or digit and closing punctuation. The most frequent words of a bounded sample, a fixed number at most, are
   encoded once and sent to every task.
2. Documents become batches of references to words. A batch's other words, once each, are shuffled by word, so that
   every distinct word meets in one place and is encoded once; its ids go back to the batches that asked.
3. Batch by batch, ids are put back by position.
Decoding joins ids with the table of pieces, whose size is the vocabulary's. Ids count up from 0 without gaps, so the
join is by position within each row's array: no id is shuffled, and the order of the ids is that of the pieces.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bounded_sample
from quire.llm.wordcache import encode_all, load

#: Words in every task's memory at most, and the documents they are counted in. Neither changes a result.
FREQUENT_WORDS = 250_000
SAMPLE_DOCS = 30_000
#: A batch ends with the text that brings it to so many bytes.
BATCH_BYTES = 6_000_000
#: Closing punctuation that is cut off a word.
_TAIL = ".,!?;:%&*$#|"
# fixed values: Unicode's white space
_SPACE = "\t\n\v\f\r \x85\xa0  -     　"
_WHITE = re.findall(f"[{_SPACE}]", "".join(map(chr, range(0x3001))))
_ASCII_WHITE = np.isin(np.arange(256), [ord(c) for c in _WHITE if c < "\x80"])
_WIDE_WHITE = [c.encode() for c in _WHITE if c >= "\x80"]
_WHITE_LEADS = np.array(sorted({c[0] for c in _WIDE_WHITE}), np.uint8)
_WORD = re.compile(f"[ ]?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


@functools.lru_cache(maxsize=4)
def _specials(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in load(path).get_added_tokens_decoder().values())


def split_words(text: str | None, specials: tuple[str, ...] = ()) -> list[str]:
    """Words whose ids, in order, are the text's ids. A text with a special token's string is one word."""
    if not text:
        return []
    if any(s in text for s in specials):
        return [text]
    return _WORD.findall(text)


def cut_word(word: str) -> tuple[str, ...]:
    """A word without its closing punctuation, and that; the tokenizer cuts there as well."""
    core = word.rstrip(_TAIL)
    if core and len(core) < len(word) and (core[-1].isalpha() or core[-1] in "0123456789"):
        return core, word[len(core) :]
    return (word,)


def frequent_words(sample: DataFrame, tokenizer: str, most: int) -> list[tuple[str, bytes]]:
    """(word, ids) of at most ``most`` words of column _text, the most frequent first, ties by name; encoded once each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        specials, seen = _specials(tokenizer), Counter()

        def out():
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
            seen.clear()

        for b in batches:
            for text in b.column(0):
                words = split_words(text.as_py(), specials)
                # a text that is one word on its own is not worth a place
                if len(words) > 1:
                    seen.update(words)
                if len(seen) > 300_000:
                    yield from out()
        yield from out()

    counts = sample.select("_text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.where("n > 1").orderBy(F.desc("n"), "word").limit(most)
    ids = top.repartition(TOP_PARTS, "word").mapInArrow(_encode_runs(tokenizer, "word"), "word string, n long, ids binary")
    return [(r.word, bytes(r.ids)) for r in sorted(ids.collect(), key=lambda r: (-r.n, r.word))]


def _id_type(tokenizer: str) -> np.dtype:
    """The narrowest type that holds every id; words' ids are shuffled and sent as such."""
    return np.dtype("<u2" if load(tokenizer).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")


def _packed(ids: list[list[int]], kind: np.dtype) -> list[bytes]:
    flat = np.fromiter(itertools.chain.from_iterable(ids), kind).tobytes()
    ends = [0, *itertools.accumulate(kind.itemsize * len(x) for x in ids)]
    return [flat[a:b] for a, b in zip(ends, ends[1:])]


def _spans(ids: list[bytes], kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All ids in one array, and where each word's begin and end."""
    ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // kind.itemsize)])
    return np.frombuffer(b"".join(ids), kind).astype(np.int32), ends


#: Tasks that encode the frequent words.
TOP_PARTS = 8


def _encode_runs(tokenizer: str, word_col: str, drop: bool = False):
    """Adds ids to rows that are sorted by a word column, which ``drop`` leaves out: a run of one word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_ids = None, b""
        for b in batches:
            if not b.num_rows:
                continue
            runs = pc.run_end_encode(b.column(word_col))
            words, ends = runs.values.to_pylist(), runs.run_ends.to_numpy()
            ids = [last_ids] if words[0] == last else []
            for at in range(len(ids), len(words), 4096):
                ids += _packed(encode_all(tokenizer, words[at : at + 4096]), _id_type(tokenizer))
            last, last_ids = words[-1], ids[-1]
            each = pa.array(ids, pa.binary()).take(pa.array(np.repeat(np.arange(len(ids)), np.diff(ends, prepend=0))))
            kept = [n for n in b.schema.names if not (drop and n == word_col)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), each], [*kept, "ids"])

    return run


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, pa.Array, pa.Array]]:
    """(key, ids, texts). The key is a hash of the batch's ids and texts. A batch ends with the text that fills it."""
    for whole in batches:
        column = whole.column(1)
        upto = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy().astype(np.int64))])
        at = 0
        while at < whole.num_rows:
            end = min(int(np.searchsorted(upto, upto[at] + BATCH_BYTES)), whole.num_rows)
            ids, texts = whole.column(0).slice(at, end - at), column.slice(at, end - at)
            h = xxhash.xxh3_128(repr(ids.to_pylist()))
            h.update(np.diff(upto[at : end + 1]).tobytes())
            h.update(texts.is_valid().to_numpy(zero_copy_only=False).tobytes())
            h.update(_text_bytes(texts)[0])
            yield h.digest(), ids, texts
            at = end


def _text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 in one array, and where each begins and the last ends. Null texts have none."""
    texts = pc.fill_null(texts, "")
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int32, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data and ends[-1] else np.zeros(0, np.uint8)
    return flat, ends - ends[0]


def _white(flat: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 belong to white space."""
    white = _ASCII_WHITE[flat]
    for lead in np.unique(flat[np.isin(flat, _WHITE_LEADS)]):
        at = np.flatnonzero(flat == lead)
        for char in _WIDE_WHITE:
            if char[0] == lead:
                found = at[at <= len(flat) - len(char)]
                for k in range(1, len(char)):
                    found = found[flat[found + k] == char[k]]
                for k in range(len(char)):
                    white[found + k] = True
    return white


def word_starts(flat: np.ndarray, text_ends: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Where the words of ``split_words`` begin in the texts' bytes, all texts at once; ``single`` marks texts that are one word.

    A run of white space is a word up to its last character, if something follows in the text. That one starts the
    next word if it is a space and else is a word itself.
    """
    if not len(flat):
        return np.zeros(0, np.int64)
    white = _white(flat)
    first = np.zeros(len(flat) + 1, bool)
    first[text_ends] = True
    start = first[:-1].copy()
    start[1:] |= white[1:] & ~white[:-1]
    ends = np.flatnonzero(~white[1:] & white[:-1] & ~first[1:-1]) + 1
    last = ends - 1
    for _ in range(2):
        # back to the first byte of a wider character
        last = np.where((flat[last] & 0xC0) == 0x80, last - 1, last)
    start[last] = True
    start[ends[flat[last] != ord(" ")]] = True
    for i in np.flatnonzero(single):
        start[text_ends[i] + 1 : text_ends[i + 1]] = False
    return np.flatnonzero(start)


def cut_words(words: pa.StringArray, specials: tuple[str, ...]) -> tuple[pa.StringArray, np.ndarray]:
    """The parts of ``cut_word`` of all words, one word after the other, and which words have two. A word with a special token's string has one."""
    flat, ends = _text_bytes(words)
    cores = pc.ascii_rtrim(words, characters=_TAIL)
    long = pc.binary_length(cores).to_numpy()
    lasts = pc.utf8_slice_codeunits(cores, start=-1).dictionary_encode()
    cuts = np.array([c.isalpha() or (c != "" and c in "0123456789") for c in lasts.dictionary.to_pylist()], bool)
    two = (long < np.diff(ends)) & cuts[lasts.indices.to_numpy()]
    for s in specials:
        two &= ~pc.match_substring(words, s).to_numpy(zero_copy_only=False)
    # a cut is a further end between a word's begin and its own end
    bounds = np.insert(ends, np.flatnonzero(two) + 1, ends[:-1][two] + long[two])
    return _strings(bounds, flat), two


def _strings(bounds: np.ndarray, flat: np.ndarray) -> pa.StringArray:
    return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(flat))


def references(texts: pa.Array, known: pa.StringArray, specials: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """References of all texts' words, how many each text has, and the batch's own words, whose references follow those of ``known``."""
    flat, ends = _text_bytes(texts)
    single = np.zeros(len(texts), bool)
    for s in specials:
        single |= pc.fill_null(pc.match_substring(texts, s), False).to_numpy(zero_copy_only=False)
    starts = word_starts(flat, ends, single)
    words = _strings(np.append(starts, len(flat)), flat).dictionary_encode()
    head = _numbers(words.dictionary, known)
    # references of the tails that are cut off; the others have none
    tail = np.full(len(head), -1, np.int64)
    new = np.flatnonzero(head < 0)
    parts, two = cut_words(words.dictionary.take(pa.array(new)), specials)
    parts = parts.dictionary_encode()
    found = _numbers(parts.dictionary, known)
    fresh = found < 0
    own = parts.dictionary.filter(pa.array(fresh))
    found[fresh] = len(known) + np.arange(len(own))
    refs_of_parts = found[parts.indices.to_numpy()]
    first = np.arange(len(new)) + np.cumsum(two) - two
    head[new] = refs_of_parts[first]
    tail[new[two]] = refs_of_parts[first[two] + 1]
    at = words.indices.to_numpy()
    heads, tails = head[at], tail[at]
    two = tails >= 0
    refs = np.empty(len(at) + int(two.sum()), "<u4")
    spot = np.arange(len(at)) + np.cumsum(two) - two
    refs[spot] = heads
    refs[spot[two] + 1] = tails[two]
    upto = np.concatenate([[0], np.cumsum(1 + two)])[np.searchsorted(starts, ends)]
    return refs, np.diff(upto), own


def _numbers(words: pa.StringArray, known: pa.StringArray) -> np.ndarray:
    """Each word's place in ``known``, or -1."""
    return pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy().astype(np.int64)


def refer(texts: pa.Array, places: dict[str, int], specials: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """``references`` with the words and their numbers as dicts."""
    refs, sizes, own = references(texts, pa.array(list(places), pa.string()), specials)
    return refs, sizes, {w: len(places) + i for i, w in enumerate(own.to_pylist())}


def encode(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT_WORDS, sample_docs: int = SAMPLE_DOCS
) -> DataFrame:
    """One row per row of ``docs``: id, ids (array of int), as the tokenizer encodes the whole text without special tokens added.

    A null or empty text has no ids. Repeated rows and null ids get a row each; an empty table gives an empty result;
    other columns are ignored. A very long text is a batch of its own. ``docs`` is read more than once and has to give
    the same rows in the same partitions each time, as files and checkpoints do; a batch that differs fails the job and
    never loses words.
    """
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    top = frequent_words(bounded_sample(src, "_id", sample_docs, src.count()), tokenizer, frequent) if frequent else []
    # bounded by ``frequent``; tasks that split texts need the words, those that put ids back need only the ids
    sc, kind_of_ids = docs.sparkSession.sparkContext, _id_type(tokenizer)
    sent, sent_ids = sc.broadcast(pa.array([w for w, _ in top], pa.string())), sc.broadcast(_spans([ids for _, ids in top], kind_of_ids))

    def skeleton(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per batch: references to words, compressed by byte planes; those of frequent words are small numbers."""
        pack = zstandard.ZstdCompressor(level=3)
        for key, ids, texts in _batches(batches):
            refs, sizes, _ = references(texts, sent.value, _specials(tokenizer))
            planes = refs.view(np.uint8).reshape(-1, 4).T.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([key], pa.binary()), _one_list(ids), _one_list(pa.array(sizes, pa.int32())), pa.array([pack.compress(planes)], pa.binary())],
                ["key", "row_ids", "sizes", "refs"],
            )

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(other_key, at, other): each batch's own words, once each, in order of spelling."""
        for key, _, texts in _batches(batches):
            own = references(texts, sent.value, _specials(tokenizer))[2]
            order = pc.sort_indices(own)
            at = pc.add(order.cast(pa.int32()), pa.scalar(len(sent.value), pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(own), pa.binary()), at, own.take(order)], ["other_key", "at", "other"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_ends = sent_ids.value
        for b in batches:
            for i in range(b.num_rows):
                sizes = b.column(1)[i].values.to_numpy()
                planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b.column(2)[i].as_py()), np.uint8)
                refs = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()
                yield from _documents(id_col, b.column(0)[i].values, sizes, refs, known, known_ends, b.column(3)[i], kind_of_ids)

    parts = src.mapInArrow(skeleton, f"key binary, row_ids array<{kind}>, sizes array<int>, refs binary")
    rare = src.mapInArrow(others, "other_key binary, at int, other string")
    # A batch asks for a word once, so one word holds no more than one of a batch's many requests, and its rows only
    # stream through: no key can hold a large share of this shuffle, and none needs to be split.
    found = rare.repartition("other").sortWithinPartitions("other").mapInArrow(_encode_runs(tokenizer, "other", drop=True), "other_key binary, at int, ids binary")
    # a batch's own words are fewer than its bytes, which are bounded
    by_batch = found.groupBy("other_key").agg(F.collect_list(F.struct("at", "ids")).alias("others"))
    whole = parts.join(by_batch, F.col("key") == F.col("other_key"), "left").select("row_ids", "sizes", "refs", "others")
    return whole.mapInArrow(assemble, f"{id_col} {kind}, ids array<int>")


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _documents(
    id_col: str, row_ids: pa.Array, sizes: np.ndarray, refs: np.ndarray, known: np.ndarray, known_ends: np.ndarray, others: pa.Scalar,
    kind_of_ids: np.dtype,
) -> Iterator[pa.RecordBatch]:
    """Ids of the documents of a batch, put back by position, some hundred documents at a time."""
    flat, ends = known, known_ends
    if others.is_valid:
        at, ids = others.values.field("at").to_numpy(), others.values.field("ids").to_pylist()
        order = np.argsort(at, kind="stable")
        # IndexError below if a word of the batch has not come back, never a document with less
        if not np.array_equal(at[order], np.arange(len(at)) + len(ends) - 1):
            raise KeyError("words of a batch are missing")
        own, own_ends = _spans([ids[i] for i in order], kind_of_ids)
        flat, ends = np.concatenate([flat, own]), np.concatenate([ends, own_ends[1:] + ends[-1]])
    starts, lengths = ends[:-1], np.diff(ends)
    upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    for lo in range(0, len(sizes), 256):
        hi = min(lo + 256, len(sizes))
        part = refs[upto[lo] : upto[hi]]
        long = lengths[part]
        after = np.concatenate([[0], np.cumsum(long)])
        # the place in ``flat`` of each id: its word's start, plus its place in the word
        places = np.repeat(starts[part] - after[:-1], long) + np.arange(after[-1])
        lists = pa.ListArray.from_arrays(pa.array(after[upto[lo : hi + 1] - upto[lo]].astype(np.int32)), pa.array(flat[places]))
        yield pa.RecordBatch.from_arrays([row_ids.slice(lo, hi - lo), lists], [id_col, "ids"])


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes for U+0100 and up."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def piece_table(tokenizer: str) -> list[bytes]:
    """Bytes of each id; its size is the vocabulary's."""
    tok, chars = load(tokenizer), byte_of_char()
    pieces = []
    for i in range(tok.get_vocab_size(with_added_tokens=True)):
        piece = tok.id_to_token(i) or ""
        # a piece outside the alphabet, as a special token with a space, stands for its own text
        pieces.append(bytes(chars[c] for c in piece) if all(c in chars for c in piece) else piece.encode())
    return pieces


def decode(ids: Column, tokenizer: str) -> Column:
    """The text of an array of ids, special tokens included; bytes that are no UTF-8 become U+FFFD. Null gives null.

    The table of pieces is a constant of the plan, one row of the vocabulary's size, joined by position.
    """
    pieces = F.split(F.lit(",".join(p.hex() for p in piece_table(tokenizer))), ",")
    found = F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")
    return F.make_valid_utf8(F.unhex(found).cast("string"))


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256. Odd rows and tables as in ``encode``."""
    encoded = encode(docs, tokenizer)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        digest.alias("ids_sha256"),
        F.sha2(decode(F.col("ids"), tokenizer).cast("binary"), 256).alias("decoded_sha256"),
    )

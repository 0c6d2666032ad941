"""Exact token ids of whole texts through a table of distinct chunks, kept in each Python worker."""

from __future__ import annotations

import functools
import itertools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@functools.lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a file, without truncation and padding."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def encode_all(path: str, texts: list[str]) -> list[list[int]]:
    """Ids of each text; the library's own threads stay off, as Spark's tasks fill the cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return [e.ids for e in load(path).encode_batch_fast(texts, add_special_tokens=False)]


def as_bytes(ids: list[list[int]]) -> list[bytes]:
    """Each list as little-endian uint32."""
    flat = np.fromiter(itertools.chain.from_iterable(ids), dtype="<u4").tobytes()
    ends = [0, *itertools.accumulate(4 * len(x) for x in ids)]
    return [flat[a:b] for a, b in zip(ends, ends[1:])]


@functools.lru_cache(maxsize=4)
def _word_ends(path: str) -> np.ndarray:
    """Which ids are the last of a word, by the suffix of their pieces."""
    tok = load(path)
    pieces = map(tok.id_to_token, range(tok.get_vocab_size(with_added_tokens=True)))
    return np.array([(p or "").endswith("</w>") for p in pieces], bool)


def encode_words(path: str, parts: list[str]) -> list[bytes]:
    """Ids of each part, as little-endian uint32, for a tokenizer that drops white space and marks the ends of words.

    Parts of letters only are encoded as texts of GROUP words, which spares most of the calls' cost. Every part ends a
    word at least once, so a text with as many ends as parts is cut right; the parts of any other are encoded each.
    """
    found: list[bytes | None] = [None] * len(parts)
    words = [i for i, p in enumerate(parts) if p.isalpha()]
    groups = [words[at : at + GROUP] for at in range(0, len(words), GROUP)]
    for group, ids in zip(groups, encode_all(path, [" ".join([parts[i] for i in g]) for g in groups])):
        flat = np.array(ids, "<u4")
        ends = (4 * np.flatnonzero(_word_ends(path)[flat]) + 4).tolist()
        if len(ends) == len(group) and ends[-1] == flat.nbytes:
            whole = flat.tobytes()
            for i, a, b in zip(group, [0, *ends], ends):
                found[i] = whole[a:b]
    rest = [i for i, ids in enumerate(found) if ids is None]
    for i, ids in zip(rest, as_bytes(encode_all(path, [parts[i] for i in rest]))):
        found[i] = ids
    return found


#: Words encoded in one text.
GROUP = 64


class ChunkTable:
    """Ids of white-space separated chunks of a lower-casing tokenizer that drops white space, as little-endian uint32 bytes.

    No token crosses ASCII white space, so a text's ids are its chunks' ids in order. Arrow finds the different chunks
    of a batch, takes closing ASCII punctuation off a letter or digit, where the tokenizer cuts too, and puts the ids
    back in order. The parts are looked up in lower case; only parts that are new are encoded. The table starts anew
    when it holds too many parts or too many bytes, which only costs encoding again.
    """

    #: A letter or digit, and the punctuation after it.
    _CUT = r"(?s)^(?P<core>.*[a-z0-9\pL])(?P<tail>[.,!?;:%&*$#|]+)$"
    _TAIL = ".,!?;:%&*$#|"

    def __init__(self, path: str, most_parts: int = 700_000, most_bytes: int = 32_000_000):
        self.path, self.most_parts, self.most_bytes = path, most_parts, most_bytes
        self.parts: dict[str, bytes] = {}
        self.held = 0

    def _ids(self, parts: list[str]) -> list[bytes]:
        """Ids of different parts, from the table or the tokenizer."""
        if len(self.parts) > self.most_parts or self.held > self.most_bytes:
            self.parts, self.held = {"": b""}, 0
        known = self.parts
        new = [p for p in parts if p not in known]
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            ids = encode_words(self.path, some)
            known.update(zip(some, ids))
            self.held += sum(map(len, some)) + sum(map(len, ids))
        return [known[p] for p in parts]

    def _chunk_ids(self, chunks: pa.Array) -> pa.Array:
        """Ids of different chunks."""
        special = pc.match_substring(chunks, "<|")
        low = pc.if_else(special, chunks, pc.ascii_lower(chunks))
        ends = pc.not_equal(pc.ascii_rtrim(low, characters=self._TAIL), low)
        cut = pc.indices_nonzero(pc.and_(ends, pc.invert(special)))
        both = pc.extract_regex(low.take(cut), self._CUT)
        core, tail = (pc.struct_field(both, name) for name in ("core", "tail"))
        cores = pc.replace_with_mask(low, *_mask(len(low), cut, pc.coalesce(core, low.take(cut))))
        parts = pa.concat_arrays([cores, pc.fill_null(tail, "")]).dictionary_encode()
        ids = pa.array(self._ids(parts.dictionary.to_pylist()), pa.large_binary()).take(parts.indices)
        of_core, of_tail = ids.slice(0, len(low)), ids.slice(len(low))
        joined = pc.binary_join_element_wise(of_core.take(cut), of_tail, pa.scalar(b"", pa.large_binary()))
        return pc.replace_with_mask(of_core, *_mask(len(low), cut, joined))

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Ids of each text; a null text has none."""
        if not isinstance(texts, pa.Array):
            texts = pa.array([(t or "").encode("utf-8", "replace") for t in texts], pa.large_binary())
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        chunks = split.flatten().dictionary_encode()
        ids = self._chunk_ids(chunks.dictionary).take(chunks.indices)
        _, ends, data = ids.buffers()
        at = np.frombuffer(ends, np.int64, len(ids) + 1)[split.offsets.to_numpy()].tolist()
        flat = memoryview(data) if data else b""
        return [bytes(flat[a:b]) for a, b in zip(at, at[1:])]


def _mask(n: int, places: pa.Array, values: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The arguments of replace_with_mask that put ``values`` at ``places``."""
    mask = np.zeros(n, bool)
    mask[places.to_numpy()] = True
    return pa.array(mask), values


@functools.lru_cache(maxsize=2)
def chunk_table(path: str) -> ChunkTable:
    return ChunkTable(path)

"""Tokenizer ids of whole texts, with a memo over white-space separated pieces.

Neither vocabulary merges across the pieces used here, so encoding each distinct piece once
with the tokenizers library gives the ids of the whole text. Splitting, counting distinct pieces
and gathering ids are Arrow kernels; the memo is bounded.

``word`` vocabularies drop white space and case: pieces are what ASCII white space separates,
with A-Z lower-cased. ``byte`` vocabularies keep both: in a text whose white space is single
spaces and line feeds, pieces are words with the space before them, and line feeds; any other
text is cut by ``KEPT``. Full stops and commas behind a word are pieces of their own. A text
that holds the string of a special token, which the library turns into that token's id wherever
it stands, is encoded whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import pairwise

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Unicode White_Space, as the tokenizers' patterns see it.
_S = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space is kept: one space joins the word behind it, the rest of a run stands alone.
KEPT = re.compile(f" ?[^{_S}]+|[{_S}]+(?![^{_S}])|[{_S}]")
#: What a text must not hold for the plain cut at spaces and line feeds (RE2).
UNEVEN = r"[\x00\t\x{0b}\x{0c}\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]"
#: A stop behind anything but a letter, digit or ASCII white space may belong to a longer run.
CLUSTER = r"[^\p{L}\p{N} \t\n\r][.,]"
#: Pieces remembered in each of two generations; a piece in use moves to the younger one.
MEMO_PIECES = 250_000
#: New pieces encoded in one call.
JOINED = 4096


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes.

    A batch's pieces are dictionary-encoded first, so each distinct one is looked up or encoded
    once a batch, and the ids of all pieces are gathered in one step.
    """

    def __init__(self, path: str, keeps_space: bool) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.keeps_space = keeps_space
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, texts) -> list[bytes]:
        """``texts``: an Arrow string array; a null is empty."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        # taking every row also copies a slice: the lower-casing kernel reads slices wrongly
        texts = pc.fill_null(texts.cast(pa.large_string()), "").take(pa.array(np.arange(len(texts))))
        whole = np.asarray(pc.match_substring_regex(texts, self.special)) if self.special else np.zeros(len(texts), dtype=bool)
        apart = whole.copy()
        if self.keeps_space:
            apart |= np.asarray(pc.match_substring_regex(texts, f"{UNEVEN}|{CLUSTER}"))
        plain = pc.if_else(pa.array(~apart), texts, pa.scalar("", pa.large_string())) if apart.any() else texts
        if self.keeps_space:
            plain = self._part_stops(plain, "\0")
            marked = pc.replace_substring(pc.replace_substring(plain, " ", "\0 "), "\n", "\0\n\0")
            split = pc.split_pattern(marked, "\0")
        else:
            low = pc.ascii_lower(plain)
            split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(low, CLUSTER), low, self._part_stops(low, " ")))
        out = self._gather(split.flatten(), np.asarray(split.offsets).astype(np.int64) - split.offsets[0].as_py())
        for i in np.flatnonzero(apart):
            text = texts[int(i)].as_py()
            if whole[i]:
                out[i] = _bytes(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)
            else:
                pieces = KEPT.findall(text)
                out[i] = self._gather(pa.array(pieces, pa.large_string()), np.array([0, len(pieces)]))[0]
        return out

    @staticmethod
    def _part_stops(texts, mark: str):
        """Set the stops before white space apart, so words with and without them are one piece."""
        import pyarrow.compute as pc

        for stop in (". ", ", ", ".\n", ",\n"):
            texts = pc.replace_substring(texts, stop, mark + stop)
        return texts

    def _gather(self, flat, ends) -> list[bytes]:
        """The ids of each run of pieces ``flat[ends[i]:ends[i + 1]]``."""
        import numpy as np
        import pyarrow as pa

        if not len(flat):
            return [b""] * (len(ends) - 1)
        coded = flat.dictionary_encode()
        ids = self._encode(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        offsets = np.zeros(len(ids) + 1, dtype=np.int64)
        np.cumsum(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)), out=offsets[1:])
        known = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(ids))])
        _, where, blob = known.take(coded.indices).buffers()
        at = np.frombuffer(where, dtype=np.int64)
        blob = memoryview(blob) if blob is not None else memoryview(b"")
        return [bytes(blob[a:b]) for a, b in pairwise(at[ends].tolist())]

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        if len(self.young) > MEMO_PIECES:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        out = list(map(young.get, pieces))
        new = []
        for i, got in enumerate(out):
            if got is None:
                p = pieces[i]
                got = old.get(p)
                if got is None:
                    new.append(i)
                else:
                    young[p] = out[i] = got
        for lo in range(0, len(new), JOINED):
            part = new[lo : lo + JOINED]
            for i, got in zip(part, self._encode_new([pieces[i] for i in part]), strict=True):
                young[pieces[i]] = out[i] = got
        return out

    def _encode_new(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, none of which holds a special token's string: one call, cut at a special token between them."""
        import numpy as np

        if not self.special:
            return [_bytes(e.ids) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        mark, text = next(iter(self.tokenizer.get_added_tokens_decoder().items()))
        ids = np.array(self.tokenizer.encode_batch_fast([text.content.join(pieces)], add_special_tokens=False)[0].ids, dtype="<u4")
        stops = (4 * np.flatnonzero(ids == mark)).tolist()
        blob = ids.tobytes()
        return [blob[a:b] for a, b in zip([0, *(x + 4 for x in stops)], [*stops, len(blob)], strict=True)]


def _bytes(ids: list[int]) -> bytes:
    return b"".join(x.to_bytes(4, "little") for x in ids)


@lru_cache(maxsize=4)
def encoder(path: str, keeps_space: bool) -> Encoder:
    """One encoder a Python worker for each vocabulary."""
    return Encoder(path, keeps_space)


def row_slices(column, most: int = 6 << 20):
    """(first, stop) rows of an Arrow string column of about ``most`` bytes together."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right"))
        hi = max(hi, lo + 1)
        yield lo, hi
        lo = hi

"""SentencePiece encoding and decoding of merge-type (BPE) models by backtracking.

The merge result of a text is the only token sequence in which every adjacent pair is *compatible*: merging the two
tokens' joined characters afresh gives just these two tokens. So an encoder may walk the text from the left, take the
longest match that an Aho-Corasick automaton reports, and step back to a shorter match or an earlier token where a
pair isn't compatible; a bitfield of positions from which no way led on keeps the walk linear.

Nulls and empty texts encode to no ids and decode to the empty text. Very long texts need memory in proportion to one
text. Rows are independent, so ties and repeated rows make no difference, and an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache

import ahocorasick
import sentencepiece
from pyspark.sql import DataFrame

from tesserae.llm.texts import KEPT, map_texts

#: SentencePiece writes a space as this mark.
SPACE = "▁"
#: Entries of each of the two generations of the memo tables; their memory is bounded by this.
MEMO = 250_000


class Memo:
    """A dict of bounded size: when the young half is full it becomes the old half; what is used moves back."""

    def __init__(self, size: int = MEMO) -> None:
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


class PieceEncoder:
    """Encodes like the library's ``encode`` does for a BPE model with byte fallback."""

    def __init__(self, model_file: str) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        lib = self.library
        ids = range(lib.get_piece_size())
        usual = [i for i in ids if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        if any(lib.is_unused(i) for i in usual):
            raise ValueError("models with unused pieces aren't supported")
        self.bytes = {int(lib.id_to_piece(i)[1:-1], 16): i for i in ids if lib.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("only models with byte fallback are supported")
        self.id = {lib.id_to_piece(i): i for i in usual}
        self.score = {p: lib.get_score(i) for p, i in self.id.items()}
        counts: dict[float, int] = {}
        for p, s in self.score.items():
            counts[s] = counts.get(s, 0) + (len(p) > 1)
        tied = [p for p, s in self.score.items() if counts[s] > 1 and len(p) > 1]
        #: Pieces of equal score are merged from the left, which compatible pairs don't describe; where one of them
        #: may occur, the merges themselves decide. In practice these are long runs of spaces.
        self.plain_run = min((len(p) for p in tied), default=1 << 30)
        if any(set(p) != {SPACE} for p in tied) or any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("pieces of equal score, or with spaces after letters, aren't supported")
        inner = {c for p in self.id if len(p) > 1 for c in p}
        alone = "".join(re.escape(c) for c in "\n\r\t" if c not in inner)
        #: No piece crosses the border of two chunks, so each can be encoded by itself.
        self.chunk = re.compile(f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" + (f"|[{alone}]" if alone else ""))
        self.automaton = ahocorasick.Automaton()
        self.shorter: dict[str, str | None] = {}
        own = {p for p in self.id if self.merged(p) == [p]}
        for p in own:
            self.automaton.add_word(p, len(p) - 1)
            self.shorter[p] = next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in own), None)
        self.automaton.make_automaton()
        #: One string for each piece and one number for each id, so that what is kept or returned holds no copies.
        self.own, self.number = {p: p for p in own}, {str(i): i for i in ids}
        self.pairs, self.chunks = Memo(), Memo()
        probe = " Der  quick\n brown\té日\U0001d4b3 fox. \x00"
        if self.encode(probe) != lib.encode(probe):
            raise ValueError("the model normalises texts in a way that isn't supported")

    def merged(self, text: str) -> list[str]:
        """The merges themselves: the best-scored, then leftmost, adjacent pair first."""
        part, n = list(text), len(text)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        score, queue = self.score, []

        def offer(i: int, j: int) -> None:
            if (s := score.get(part[i] + part[j])) is not None:
                heapq.heappush(queue, (-s, i, j, len(part[i]) + len(part[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, size = heapq.heappop(queue)
            if not part[i] or not part[j] or right[i] != j or len(part[i]) + len(part[j]) != size:
                continue
            part[i], part[j] = part[i] + part[j], ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
                offer(i, right[j])
            if left[i] >= 0:
                offer(left[i], i)
        return [p for p in part if p]

    def compatible(self, a: str, b: str) -> bool:
        pair = self.own.get(a, a), self.own.get(b, b)
        found = self.pairs.get(pair)
        if found is None:
            found = self.merged(a + b) == [a, b]
            self.pairs.put(pair, found)
        return found

    def tokens(self, text: str) -> list[str]:
        """The pieces of one chunk, by backtracking; a character without a piece stands for itself."""
        if text.startswith(SPACE * self.plain_run):
            return self.merged(text)
        n = len(text)
        longest = [1] * n
        for end, more in self.automaton.iter(text):  # ends ascend, so the last match from a start is its longest
            longest[end - more] = more + 1
        open_at, out, pos = bytearray(b"\x01") * (n + 1), [], 0
        token, pairs = text[: longest[0]], self.pairs.young
        while True:
            end = pos + len(token)
            if open_at[end] and (not out or (pairs[out[-1], token] if (out[-1], token) in pairs else self.compatible(out[-1], token))):
                out.append(token)
                if end == n:
                    return out
                pos, token = end, text[end : end + longest[end]]
                continue
            while (token := self.shorter.get(token)) is None:
                open_at[pos] = 0
                token = out.pop()
                pos -= len(token)

    def ids(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            if (i := self.id.get(p)) is not None:
                out.append(i)
            else:
                out += [self.bytes[b] for b in p.encode()]
        return out

    def chunk_ids(self, chunk: str) -> str:
        """The ids joined by commas: one string takes half the memory of a tuple of them."""
        found = self.chunks.get(chunk)
        if found is None:
            found = ",".join(map(str, self.ids(self.tokens(chunk))))
            if len(chunk) < 100:
                self.chunks.put(chunk, found)
        return found

    def encode_parts(self, text: str) -> tuple[list[int], str]:
        """The ids, and the same joined by commas."""
        if not text:
            return [], ""
        chunks = self.chunk.findall(SPACE + text.replace(" ", SPACE))
        parts = list(map(self.chunks.young.get, chunks))
        if None in parts:
            slow = self.chunk_ids
            parts = [p or slow(c) for p, c in zip(parts, chunks, strict=True)]
        said = ",".join(parts)
        return list(map(self.number.__getitem__, said.split(","))), said

    def encode(self, text: str) -> list[int]:
        return self.encode_parts(text)[0]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids) if ids else ""


@lru_cache(maxsize=2)
def encoder(model_file: str) -> PieceEncoder:
    """One encoder for each Python worker."""
    return PieceEncoder(model_file)


# the memo tables stay from task to task, until a task of another operator runs in the worker
KEPT["pieces"] = encoder.cache_clear


def resolve(model: str) -> str:
    """A file's path, or the name of a file of the installed public tokenizers; looked up where it is used."""
    if "/" in model:
        return model
    import public_tokenizers

    return public_tokenizers.path(model)


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """``id_col, ids array<int>, n_tokens, ids_sha256, decoded, decoded_sha256`` for every row.

    With ``keep_ids`` false the two large columns are left out. ``model`` is a path on every executor or a file name
    of the installed public tokenizers. Map-only: no shuffle; memory is one Arrow batch and the bounded memo tables."""
    wide = ", ids array<int>, decoded string" if keep_ids else ""

    def start():
        enc = encoder(resolve(model))

        def work(texts: list[str | None]) -> list[list]:
            rows = []
            for text in texts:
                ids, said = enc.encode_parts(text or "")
                back = enc.decode(ids)
                rows.append((len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), *((ids, back) if keep_ids else ())))
            return [list(c) for c in zip(*rows, strict=True)]

        return work

    return map_texts(docs, {id_col: id_col}, text_col, f"n_tokens long, ids_sha256 string, decoded_sha256 string{wide}", start, owner="pieces")

"""Token counts by a linear longest-match automaton: a vocabulary trie with failure links and precomputed popped-token counts."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, claim, numbered, quoted

CACHE_WORDS = 500_000


class LongestMatch:
    """Greedy longest-match piece counts of words in one pass over their bytes, without building pieces.

    ``first`` are the pieces a word may begin with and ``rest`` those that may follow (the same where the vocabulary makes no
    difference); a piece is a sequence of symbols, here bytes and the end of a word. Where a node has no child for
    the next byte, its failure link leads to the node of what is left after popping the longest pieces, whose number
    is stored with the link; so each byte is read once.
    """

    def __init__(self, first: Iterable[tuple[int, ...]], rest: Iterable[tuple[int, ...]] | None = None):
        self.next: list[dict[int, int]] = [{}]
        self.final = [False]
        head = self._insert(0, first)
        if rest is None:
            self.rest = 0
        else:
            self.rest = self._node()
            head = max(head, self._insert(self.rest, rest))
        self.fail = [-1] * len(self.next)
        self.pops = [0] * len(self.next)
        queue = deque((c, v, r) for r in {0, self.rest} for c, v in self.next[r].items())
        parent = dict.fromkeys(range(len(self.next)), 0)
        for u, kids in enumerate(self.next):
            for v in kids.values():
                parent[v] = u
        while queue:
            c, v, _ = queue.popleft()
            if self.final[v]:
                self.fail[v], self.pops[v] = self.rest, 1
            else:
                u = parent[v]
                z, n = self.fail[u], self.pops[u]
                while z >= 0 and c not in self.next[z]:
                    n += self.pops[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.pops[v] = self.next[z][c], n
            queue.extend((d, w, v) for d, w in self.next[v].items())

    def _node(self) -> int:
        self.next.append({})
        self.final.append(False)
        return len(self.next) - 1

    def _insert(self, root: int, pieces: Iterable[tuple[int, ...]]) -> int:
        for piece in pieces:
            v = root
            for c in piece:
                w = self.next[v].get(c)
                if w is None:
                    w = self.next[v][c] = self._node()
                v = w
            if v != root:
                self.final[v] = True
        return root

    def count(self, word: Iterable[int]) -> int:
        """The number of pieces, or -1 if greedy matching gets stuck."""
        nxt, fail, pops = self.next, self.fail, self.pops
        v = n = 0
        for c in word:
            while c not in nxt[v]:
                if fail[v] < 0:
                    return -1
                n += pops[v]
                v = fail[v]
            v = nxt[v][c]
        while v not in (0, self.rest):
            if fail[v] < 0:
                return -1
            n += pops[v]
            v = fail[v]
        return n


#: The symbol that closes a word, beside the 256 bytes.
END = 256


def byte_vocabulary(tokenizer: str) -> set[tuple[int, ...]]:
    """The pieces of a byte-level vocabulary file as sequences of bytes, with END where a piece closes a word (``</w>``).

    END alone is a piece, too, the last resort of a word that ends in a piece only known inside words. All single bytes are among the
    pieces, so greedy matching never gets stuck.
    """
    import json

    import public_tokenizers

    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(keep))}
    with open(tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    pieces = {(END,)}
    for piece in vocab:
        body = piece.removesuffix("</w>")
        if body and all(c in table for c in body):
            pieces.add((*(table[c] for c in body), *([END] if body != piece else [])))
    return pieces


def count_tokens(
    docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", lower: bool = True
) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_tokens, n_unknown.

    Words are runs outside ASCII white space, lower-cased if ``lower``; each, closed by the end symbol, is matched greedily against
    the vocabulary's pieces, of which some hold the end and stand there only. A word that cannot be matched counts as one token and as unknown.
    Null or blank text: zeros. Keys may repeat or be null; other columns are not read; an empty table stays empty.
    A worker keeps the automaton and counts of up to CACHE_WORDS words from task to task.
    """
    rows = docs.select(F.col(quoted(key)).alias(key), F.col(quoted(text)).cast("string").alias("text"))
    kind = rows.schema[key].dataType.simpleString()

    class Counts(dict):
        def __init__(self):
            super().__init__()
            self.match = LongestMatch(byte_vocabulary(tokenizer))

        def __missing__(self, word: bytes) -> int:
            if len(self) >= CACHE_WORDS:
                self.clear()
            low = word.decode().lower().encode() if lower else word
            n = self[word] = self.match.count((*low, END))
            return n

    def run(batches):
        import pyarrow as pa

        state = claim("tokens")
        if state.get("tokenizer") != (tokenizer, lower):
            state["tokenizer"], state["counts"] = (tokenizer, lower), Counts()
        counts = state["counts"]
        for b in batches:
            words, tokens, unknown = [], [], []
            for t in as_bytes(b.column(1)):
                each = list(map(counts.__getitem__, (t.lower() if lower else t).split()))  # A-Z at once, other letters word by word
                bad = each.count(-1)
                words.append(len(each))
                tokens.append(sum(each) + 2 * bad)
                unknown.append(bad)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))], names=[key, "n_words", "n_tokens", "n_unknown"]
            )

    return numbered(rows).mapInArrow(run, f"{quoted(key)} {kind}, n_words long, n_tokens long, n_unknown long")

"""Token counts by unigram segmentation, worked out once for each shared prefix of distinct pre-tokens.

A task puts the distinct pre-tokens of a slice of its rows into a trie. The best forward score and token count of a
prefix belong to its trie node, so words with a common beginning share them; a pre-token's own count is stored at its
terminal node. Sorted words make the nodes of a depth neighbours, so a depth is worked out at once (``level_trie``); words
of over ``deep`` characters are inserted one by one (``ForwardTrie``), by the same rule. A document's counts are sums over
its pre-tokens. No shuffle: a trie is a task's own and has ``max_nodes`` at most (a longer pre-token: its length), so memory
is bounded.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.common import text_slices

#: Fixed value: the mark that begins a pre-token. White space between them is ``[\\x20\\x09-\\x0D]``, as ``bytes.split`` has it.
MARK = "▁"
COUNTS = "doc_id long, n_pretokens long, n_tokens long, score double"


def sentencepiece_path() -> str:
    """The public piece file, as installed where the task runs."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def unigram_pieces(path: str) -> dict[str, float]:
    """Pieces of a vocabulary file with log probabilities by Zipf's law over their order (it lists frequent ones first)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))]
    total = math.fsum(1 / (r + 1) for r in range(len(pieces)))
    return {p: -math.log((r + 1) * total) for r, p in enumerate(pieces)}


class ForwardTrie:
    """Nodes of inserted pre-tokens with the best segmentation score and token count of their prefix.

    Of equally good segmentations the one with the longest last piece counts. A character that ends no piece
    counts as a token for each UTF-8 byte, at ``byte_score`` each.
    """

    def __init__(self, pieces: dict[str, float], byte_score: float | None = None):
        self.byte_score = min(pieces.values(), default=0.0) - 10 if byte_score is None else byte_score
        # suffixes of pieces, from the end: a lookup stops where no piece goes on; None for those that are no piece
        self.tails = dict.fromkeys(p[i:] for p in pieces for i in range(len(p))) | pieces
        self.clear()

    def clear(self) -> None:
        """Only the root is left."""
        self.next: dict[tuple[int, str], int] = {}
        self.score, self.count = [0.0], [0]
        self.terminal: dict[str, tuple[int, float]] = {}

    def insert(self, word: str) -> tuple[int, float]:
        """Token count and score of ``word``; only nodes that are new are worked out."""
        if (known := self.terminal.get(word)) is not None:
            return known
        path, node = [0], 0
        score, count, tails, step = self.score, self.count, self.tails, self.next
        for i, ch in enumerate(word):
            child = step.get((node, ch))
            if child is None:
                n = 1 if ch < "\x80" else len(ch.encode("utf-8", "surrogatepass"))
                best, tokens = score[node] + n * self.byte_score, count[node] + n
                for a in range(i, -1, -1):
                    value = tails.get(word[a:i + 1], 0)
                    if value == 0:
                        break
                    if value is not None and score[path[a]] + value >= best:
                        best, tokens = score[path[a]] + value, count[path[a]] + 1
                child = len(score)
                step[node, ch] = child
                score.append(best)
                count.append(tokens)
            path.append(child)
            node = child
        self.terminal[word] = out = (count[node], score[node])
        return out


class Tails:
    """The suffixes of all pieces as an automaton that reads a word backwards; state 0 has read nothing."""

    def __init__(self, pieces: dict[str, float]):
        names = sorted({p[i:] for p in pieces for i in range(len(p))}, key=len)
        state = {"": 0} | {t: i + 1 for i, t in enumerate(names)}
        move = np.array([state[t[1:]] << 21 | ord(t[0]) for t in names], np.int64)
        order = np.argsort(move)
        self.moves, self.states = move[order], order + 1
        self.longest = max(map(len, names), default=0)
        self.value = np.array([-np.inf, *(pieces.get(t, -np.inf) for t in names)])

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The next states; -1 where no piece goes on."""
        if len(self.moves) == 0:
            return np.full(len(state), -1)
        move = state << 21 | char
        at = np.minimum(np.searchsorted(self.moves, move), len(self.moves) - 1)
        return np.where(self.moves[at] == move, self.states[at], -1)


def level_trie(words: list[str], tails: Tails, byte_score: float) -> tuple[np.ndarray, np.ndarray]:
    """Token counts and scores of sorted, distinct, non-empty words, by a trie that grows a depth at a time."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    begin = np.cumsum(lens) - lens
    score, count = np.zeros(1), np.zeros(1, np.int64)
    tokens, scores = np.zeros(len(words), np.int64), np.zeros(len(words))
    nodes = [np.zeros(len(words), np.int32)]  # each word's node of a depth; those a piece reaches back to are kept
    shares = np.arange(len(words)) > 0  # with the word before, up to this depth
    for d in range(int(lens.max(initial=0))):
        on = np.flatnonzero(lens > d)
        here = np.full(len(words), -1)
        here[on] = chars[begin[on] + d]
        shares[1:] &= (here[1:] == here[:-1]) & (here[1:] >= 0)
        fresh = ~shares[on]
        made = on[fresh]  # the first word of each new node
        node = np.zeros(len(words), np.int32)
        node[on] = len(score) + np.cumsum(fresh) - 1
        size = 1 + (here[made] >= 0x80) + (here[made] >= 0x800) + (here[made] >= 0x10000)
        best = score[nodes[d][made]] + size * byte_score
        best_count = count[nodes[d][made]] + size
        left, state = np.arange(len(made)), np.zeros(len(made), np.int64)
        for a in range(d, -1, -1):
            state = tails.step(state, chars[begin[made[left]] + a])
            left, state = left[state >= 0], state[state >= 0]
            if len(left) == 0:
                break
            above = nodes[a][made[left]]
            value = score[above] + tails.value[state]
            better = value >= best[left]
            best[left[better]] = value[better]
            best_count[left[better]] = count[above[better]] + 1
        score, count = np.concatenate([score, best]), np.concatenate([count, best_count])
        nodes.append(node)
        if d >= tails.longest:
            nodes[d - tails.longest] = None
        done = on[lens[on] == d + 1]
        tokens[done], scores[done] = count[node[done]], score[node[done]]
    return tokens, scores


def segmented(words: list[str], trie: ForwardTrie, tails: Tails, max_nodes: int, deep: int) -> dict[str, tuple[int, float]]:
    """Token count and score of each of the sorted, distinct ``words``; a trie for every ``max_nodes`` characters."""
    out = {w: trie.insert(w) for w in words if len(w) > deep}
    trie.clear()
    short = [w for w in words if len(w) <= deep]
    i = 0
    ends = np.cumsum([len(w) for w in short])
    while i < len(short):
        before = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + max_nodes, side="right")))
        counts, scores = level_trie(short[i:j], tails, trie.byte_score)
        out.update(zip(short[i:j], zip(counts.tolist(), scores.tolist())))
        i = j
    return out


def token_counts(docs: DataFrame, pieces_path: str | Callable[[], str] = sentencepiece_path, max_nodes: int = 1_000_000,
                 deep: int = 64) -> DataFrame:
    """``doc_id, n_pretokens, n_tokens, score`` of each document's whole text.

    A pre-token is a run without white space, begun by a mark. Null and empty texts have none; null and repeated
    ids keep a row each; other columns are ignored; an empty table gives an empty result. ``max_nodes`` and ``deep``
    bound memory and change no result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = unigram_pieces(pieces_path() if callable(pieces_path) else pieces_path)
        trie, tails = ForwardTrie(pieces), Tails(pieces)
        for batch in batches:
            for i, m in text_slices(batch, max_bytes=8 << 20):
                piece = batch.slice(i, m)
                words = [Counter((t or "").encode("utf-8", "surrogatepass").split()) for t in piece.column("text").to_pylist()]
                names = sorted(set().union(*words))  # the order of bytes is that of characters
                marked = [MARK + w.decode("utf-8", "surrogatepass") for w in names]
                told = segmented(marked, trie, tails, max_nodes, deep)
                found = {w: told[x] for w, x in zip(names, marked)}
                pre, tokens, scores = [], [], []
                for doc in words:
                    terms = [(times, *found[w]) for w, times in doc.items()]
                    pre.append(doc.total())
                    tokens.append(sum(times * c for times, c, _ in terms))
                    scores.append(math.fsum(times * value for times, _, value in terms))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(pre, pa.int64()), pa.array(tokens, pa.int64()),
                                                  pa.array(scores, pa.float64())], names=["doc_id", "n_pretokens", "n_tokens", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, COUNTS)

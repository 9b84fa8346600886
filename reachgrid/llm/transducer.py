"""Token counts by a tokenizer compiled to a finite-state transducer.

The tokens of a text's prefix are fixed by the prefix alone, and a token sequence is the tokenizer's own
exactly if each neighbouring pair is what the tokenizer makes of the pair's text. So the last token of a
prefix is the one vocabulary piece that ends there and fits the last token of what stands before it. What
later characters can depend on is finite: for each suffix that begins some piece, its trie node, the token before
it and how many tokens ago it was. That is the state. Reading a character leads to one next state and emits the
change of the token count, so the machine is deterministic. States and transitions are made when first met.

A chunk of text maps the state before it to the state behind it and a count. Chunks are cut where a space
follows another character: no piece spans such a place, so every state goes to the same one there, a
chunk's map is constant but for its count, and composing maps adds counts. The scan over all chunks is a
prefix sum, read off at the ends of the texts. Equal chunks are run once per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachgrid.llm.words import blocks

VOCABULARY = "piece_bpe_32k.model"
LIMIT = 4096
SPACE = "▁"  # what the tokenizer puts for a space, and in front of a text
#: States that a worker keeps; beyond, it starts anew with none, which changes no result.
MOST_STATES = 400_000


class Transducer:
    """The deterministic counting machine of one byte-fallback pair-merging vocabulary."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
        self.score = {model.id_to_piece(i): model.get_score(i) for i in range(model.vocab_size()) if not any(f(i) for f in special)}
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece has a space inside or behind; chunks cannot be cut at spaces")
        self.children: list[dict[str, int]] = [{}]
        self.piece: list[str | None] = [None]
        for p in self.score:
            node = 0
            for ch in p:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.piece.append(None)
                node = self.children[node][ch]
            self.piece[node] = p
        self.fit: dict[tuple[str, str], bool] = {}
        self.forget()

    def forget(self) -> None:
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        #: Per state, character to (next state, tokens emitted).
        self.moves: list[dict[str, tuple[int, int]]] = []
        self.start = self._state(((0, "", 0),))

    def _state(self, entries: tuple) -> int:
        if entries not in self.number:
            self.number[entries] = len(self.states)
            self.states.append(entries)
            self.moves.append({})
        return self.number[entries]

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text: the best-scored neighbouring pair merges first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, before: str, token: str) -> bool:
        key = (before, token)
        if key not in self.fit:
            self.fit[key] = self.merged(before + token) == ([before, token] if before else [token])
        return self.fit[key]

    def _move(self, state: int, ch: str) -> tuple[int, int]:
        """Next state and emitted tokens; counts inside a state are relative to its own."""
        last, count, alive = None, 0, []
        for node, before, ago in self.states[state]:
            child = self.children[node].get(ch)
            if child is None:
                continue
            if self.children[child]:
                # In front of a space only a space can still matter.
                kept = before if ch != SPACE or before.endswith(SPACE) else ""
                alive.append((child, kept, ago))
            token = self.piece[child]
            if token is not None and last is None and self._fits(before, token):
                last, count = token, ago + 1
        if last is None:  # no piece: one token per byte; nothing merges with a character that stands alone
            before = self.states[state][-1]
            last, count = (ch if ch in self.children[0] else ""), before[2] + len(ch.encode())
        entries = tuple((node, before, ago - count) for node, before, ago in alive) + ((0, last, 0),)
        return self._state(entries), count

    def run(self, text: str, state: int | None = None) -> tuple[int, int]:
        """The state behind ``text`` and the tokens it emits."""
        state, total, moves = self.start if state is None else state, 0, self.moves
        for ch in text:
            move = moves[state].get(ch)
            if move is None:
                move = moves[state][ch] = self._move(state, ch)
            state = move[0]
            total += move[1]
        return state, total

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        if len(self.states) > MOST_STATES:
            self.forget()
        # Several spaces in a row, or the mark itself in a text, stay inside one chunk.
        hard = pc.match_substring_regex(texts, f"^ |  |{SPACE}").to_numpy(zero_copy_only=False)
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        pieces = pc.split_pattern(pc.if_else(pa.array(hard), "", texts), " ")
        coded = pieces.flatten().dictionary_encode()
        run = self.run
        each = np.fromiter((run(SPACE + w)[1] for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        scan = np.concatenate(([0], np.cumsum(each[coded.indices.to_numpy()])))
        ends = np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64))
        out = np.diff(scan[np.concatenate(([0], ends))])
        out[empty] = 0
        out[hard] = [run(SPACE + t.replace(" ", SPACE))[1] for t in texts.filter(pa.array(hard)).to_pylist()]
        return out


_MACHINES: dict[str, Transducer] = {}


def machine(path: str) -> Transducer:
    """One machine per worker process."""
    if path not in _MACHINES:
        _MACHINES[path] = Transducer(path)
    return _MACHINES[path]


def token_counts(docs: DataFrame, tokenizer_path: str, *, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row; a NULL text is empty. Other columns are ignored.

    The file at ``tokenizer_path`` must be found on every executor, as the library's own files are.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = machine(tokenizer_path)
        for block in blocks(batches):
            text = block.column("text")
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pc.binary_length(text).cast(pa.int64()), pa.array(counter.counts(text))],
                                             names=["doc_id", "n_bytes", "n_tokens"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    out = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)

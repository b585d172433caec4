"""Token counts by a tokenizer compiled to a finite-state transducer."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceworks.llm.memo import Memo, broadcast_bytes, small_batches
from sourceworks.llm.text import whole
from sourceworks.session import ship_package

BLANK = "▁"
MOST_STATES = 150_000
LONG_CHUNK = 256


class Merges:
    """The merge rule of a piece model: neighbours whose joint piece has the best score join, the leftmost of equals."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_proto=model)
        ids = range(library.get_piece_size())
        # Scores of these models are ranks; special, byte and unused pieces take no part in merges.
        self.score = {
            library.id_to_piece(i): library.get_score(i)
            for i in ids
            if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))
        }
        # Blanks at the start of a text: the model may put one there, and change or drop others.
        self.normalize = library.normalize
        self._as_given = {t: library.normalize(t) for t in ("a b", "a  b", " a ", "a\tb\nc\réＡ ")}
        self.plain = all(n == BLANK + t.replace(" ", BLANK) for t, n in self._as_given.items())

    def split(self, text: str) -> list[str]:
        """The pieces of a short string by the rule itself; used to compile, never on whole texts."""
        parts, score = list(text), self.score
        while True:
            found = [(-score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in score]
            if not found:
                return parts
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]


class Transducer:
    """Reads characters; a transition adds the change in the number of tokens of what was read.

    Joining never crosses the border between two final tokens, so a row of tokens
    is the tokenization of its text exactly if each neighbouring pair is that of
    the pair's own text. Hence the last token of what was read so far follows from
    the last tokens at the few earlier places from where a piece can still go on,
    and a state is just these: (open text, last token before it, tokens there
    minus tokens now). States and transitions are made on first use, are the same
    in every process, and are forgotten when ``MOST_STATES`` are held.
    """

    START = (("", None, 0),)

    def __init__(self, merges: Merges):
        self._merges = merges
        self._pieces = set(merges.score)
        self._opens = {p[:n] for p in self._pieces for n in range(1, len(p))}
        self._pair: dict[tuple[str | None, str], bool] = Memo(self._fits, 400_000)
        self._reset()

    def _reset(self) -> None:
        self.number = {self.START: 0}
        self.states = [self.START]
        self.next: list[dict[str, tuple[int, int]]] = [{}]

    def _fits(self, pair: tuple[str | None, str]) -> bool:
        before, token = pair
        if before is None:
            return self._merges.split(token) == [token]
        return self._merges.split(before + token) == [before, token]

    def _make(self, state: int, char: str) -> tuple[int, int]:
        if char not in self._pieces and char not in self._opens:
            # Not in any piece: as many byte tokens as it has bytes, and nothing goes on over it.
            return 0, len(char.encode("utf-8"))
        token, tokens, longer = None, 0, []
        # The longest piece comes first; exactly one fits what stands before it.
        for open_text, before, at in self.states[state]:
            text = open_text + char
            if token is None and (text in self._pieces or not open_text) and self._pair[before, text]:
                token, tokens = text, at + (1 if text in self._pieces else len(char.encode("utf-8")))
            if text in self._opens:
                longer.append((text, before, at))
        made = (*[(t, b, at - tokens) for t, b, at in longer], ("", token, 0))
        if made not in self.number:
            self.number[made] = len(self.states)
            self.states.append(made)
            self.next.append({})
        return self.number[made], tokens

    def run(self, state: int, chunk: str) -> tuple[int, int]:
        """The state map of a chunk at one state: where it leads, and the tokens it adds."""
        total, arcs = 0, self.next
        for char in chunk:
            arc = arcs[state].get(char)
            if arc is None:
                arc = arcs[state][char] = self._make(state, char)
            state, added = arc
            total += added
        return state, total

    def tokens(self, chunk: str) -> int:
        """Tokens of a chunk from the start state; a long chunk goes piece by piece, its states handed on."""
        if len(self.states) > MOST_STATES:
            self._reset()
        state = total = 0
        for at in range(0, len(chunk), LONG_CHUNK):
            state, added = self.run(state, chunk[at : at + LONG_CHUNK])
            total += added
        return total


class Counter:
    """Tokens of whole texts.

    No piece has a blank after another character, so every transition on a blank
    after a non-blank leads to one state whatever went before: the map of a chunk that starts there is a
    constant, and maps compose by adding. Chunks seen before are looked up; the scan over
    the chunks of a batch is one running sum, of which each text takes its part.
    """

    def __init__(self, model: bytes):
        merges = Merges(model)
        if any(BLANK in p.lstrip(BLANK) for p in merges.score):
            raise ValueError("a piece of the model has a blank inside: chunks can't start at blanks")
        if not merges.plain:
            raise ValueError("the model changes texts before it splits them: only blanks for spaces and one in front are known")
        self._machine = Transducer(merges)
        self._known = Memo(lambda chunk: self._machine.tokens(BLANK + chunk), 400_000)
        self._runs = Memo(self._machine.tokens, 50_000)

    def counts(self, texts: list[str]) -> np.ndarray:
        values: list[int] = []
        ends = np.empty(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            if text:
                if BLANK in text:
                    text = text.replace(BLANK, " ")
                chunks = text.split(" ")
                if "" in chunks:
                    values += map(self._runs.__getitem__, _with_blanks(chunks))
                else:
                    values += map(self._known.__getitem__, chunks)
            ends[i] = len(values)
        scan = np.concatenate([[0], np.cumsum(np.array(values, dtype=np.int64))])
        return np.diff(scan[ends], prepend=0)


def _with_blanks(chunks: list[str]) -> Iterator[str]:
    """Chunks with all blanks in front of them, where several spaces stand together."""
    blanks = ""
    for chunk in chunks:
        blanks += BLANK
        if chunk:
            yield blanks + chunk
            blanks = ""
    if blanks:
        yield blanks


_counters = Memo(Counter, 4)


def _counted(model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters[model.value]
        for batch in small_batches(batches):
            text = batch.column("text")
            counts = counter.counts(text.to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts)], names=["doc_id", "n_bytes", "n_tokens"]
            )

    return run


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of every document.

    ``model`` is the path of a piece model (merges by score, bytes for unknown
    characters, spaces as blanks). Counts are those of its library without begin,
    end or other special tokens; strings that look like them are plain text. Nothing is shuffled.
    Null texts count as empty and have no tokens; every row gives a row.
    """
    ship_package(docs.sparkSession)
    text = whole("text")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("bigint").alias("n_bytes")
    )
    counted = rows.mapInArrow(
        _counted(broadcast_bytes(docs.sparkSession, model)), "doc_id bigint, n_bytes bigint, n_tokens bigint"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

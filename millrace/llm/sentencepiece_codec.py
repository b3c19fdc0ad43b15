"""SentencePiece encoding and decoding: shared-prefix Viterbi over the distinct marked words of a batch of texts.

Spaces become the mark U+2581, a text gets one mark in front, and it is cut where no piece of the vocabulary can reach
across: before each run of marks, and at line ends. The distinct words of a batch are sorted, which lays out their
trie, and are visited depth-first: the forward scores of a prefix stay on a stack and serve every word that shares it.

The best path to a prefix maximizes the sum of piece scores; ties go to the longer last piece. In a BPE model a path may
only join pieces that merging leaves side by side, which is a condition of the same recursion: a sequence of pieces is
what merging gives exactly if each two neighbours, merged alone, stay as they are, so the best path that meets it is the
library's own segmentation. Which neighbours may meet is remembered. Characters outside of the vocabulary fall back to
bytes, at a penalty a character. Each text's ids are joined from those of its words; decoding maps ids back.

Scale: one narrow pass, no shuffle; a worker remembers at most about 2 * `cache_words` words and holds one slice of texts.
Broadcast is the vocabulary, whose size is the model's. The model file is read on the driver only.

Defined cases: null and empty text have no ids and decode to the empty text; a text's own U+2581 decodes to a space, as
in the format itself (round_trip is then false); very long texts and words take time in proportion to their length.
Only doc_id and text are read.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: The library's penalty below the least score for characters that have no piece (a fixed value of the format).
UNKNOWN_PENALTY = 10.0


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialized protocol buffer: just what reading a model's kind needs."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


def is_bpe(model_file: str) -> bool:
    """The model's kind: field 3 of its trainer settings (field 2) is 1 for unigram, 2 for BPE."""
    with open(model_file, "rb") as f:
        trainer = next((v for k, v in _fields(f.read()) if k == 2), b"")
    return next((v for k, v in _fields(trainer) if k == 3), 1) == 2


def check_normalizer(model_file: str) -> None:
    """Raises if the model changes texts in another way than a mark before the text and for each blank: by its normalizer
    settings (field 3) it may have no table of characters (2), and must add the mark (3), keep white space (4) and escape
    it (5); fields that aren't there are true."""
    with open(model_file, "rb") as f:
        settings = dict(_fields(next((v for k, v in _fields(f.read()) if k == 3), b"")))
    if settings.get(2) or not settings.get(3, 1) or settings.get(4, 1) or not settings.get(5, 1):
        raise ValueError("the model normalizes texts; only models that leave them as they are can be read")


def merged(text: str, scores: dict[str, float]) -> list[str]:
    """Merging done literally, for short strings: the best-scored neighbours first, the leftmost of equals."""
    parts, score_of = list(text), scores.get
    while len(parts) > 1:
        top, at = None, 0
        for k in range(len(parts) - 1):
            s = score_of(parts[k] + parts[k + 1])
            if s is not None and (top is None or s > top):
                top, at = s, k
        if top is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


@dataclass
class Vocabulary:
    bpe: bool
    scores: dict[str, float]
    values: list[float]  # of each id; a character of bytes has its penalty on the first one
    pieces: list[str]  # of each id; empty if no text gives it
    ends: dict  # trie of reversed pieces; a piece's id is under ""
    decoded: list[bytes]  # of each id
    byte_ids: list[int]  # of each byte value
    unknown_score: float
    #: What a worker process remembers from task to task, as the broadcast value stays with it.
    new_words: dict[str, bytes] = field(default_factory=dict)
    old_words: dict[str, bytes] = field(default_factory=dict)
    may_meet: dict[int, bool] = field(default_factory=dict)

    @staticmethod
    def load(model_file: str) -> Vocabulary:
        import sentencepiece

        check_normalizer(model_file)
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        scores, ids, decoded, byte_ids = {}, {}, [], [-1] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                byte_ids[value] = i
                decoded.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                decoded.append(b"")
            else:
                scores[piece], ids[piece] = sp.get_score(i), i
                decoded.append(piece.replace(MARK, " ").encode())
        if min(byte_ids) < 0:
            raise ValueError("the model has no byte fallback")
        if any(MARK in piece.lstrip(MARK) or "\n" in piece for piece in scores):
            raise ValueError("a piece reaches across words; this model can't be cut at marks")
        return Vocabulary.of(is_bpe(model_file), scores, ids, decoded, byte_ids, min(scores.values()) - UNKNOWN_PENALTY)

    @staticmethod
    def of(bpe: bool, scores: dict[str, float], ids: dict[str, int], decoded: list[bytes], byte_ids: list[int], unknown_score: float) -> Vocabulary:
        """A vocabulary from its pieces; those of a BPE model that merging never gives are left out of the trie."""
        pieces, ends, values = [""] * len(decoded), {}, [0.0] * len(decoded)
        for b, i in enumerate(byte_ids):
            values[i] = 0.0 if b & 0xC0 == 0x80 else unknown_score
        for piece, i in ids.items():
            if bpe and merged(piece, scores) != [piece]:
                continue
            pieces[i], values[i], node = piece, scores[piece], ends
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = i
        return Vocabulary(bpe, scores, values, pieces, ends, decoded, byte_ids, unknown_score)

    def segment(self, words: list[str], may_meet: dict[int, bool]) -> Iterator[tuple[str, bytes, float]]:
        """(word, ids as int32 bytes, score of its path) for sorted distinct words: a depth-first walk over their trie.
        may_meet remembers which pieces of a BPE model may be neighbours, by left id * number of pieces + right id."""
        before, score, last, start = "", [0.0], [-1], [0]
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del score[shared + 1 :], last[shared + 1 :], start[shared + 1 :]
            self._forward(word, shared + 1, score, last, start, may_meet)
            found, end = [], len(word)
            while end:
                i, k = last[end], start[end]
                if i >= 0:
                    found.append(i)
                else:
                    found.extend([self.byte_ids[b] for b in reversed(word[k:end].encode())])
                end = k
            found.reverse()
            before = word
            yield word, array("i", found).tobytes(), score[-1]

    def ids_of(self, words: set[str], most: int) -> dict[str, bytes]:
        """Ids (int32 bytes) of at least these words. Of what was asked before, up to 2 * most words are remembered, in
        two generations; the older one goes as a whole."""
        if len(self.new_words) + len(words) > most:
            self.old_words, self.new_words = self.new_words, {}
        if len(self.may_meet) > 4 * most:
            self.may_meet.clear()
        known, older = self.new_words, self.old_words
        missing = []
        for word in words - known.keys():
            ids = older.get(word)
            if ids is None:
                missing.append(word)
            else:
                known[word] = ids
        known.update((word, ids) for word, ids, _ in self.segment(sorted(missing), self.may_meet))
        return known

    def _forward(self, word: str, first: int, score: list[float], last: list[int], start: list[int], may_meet: dict[int, bool]) -> None:
        """For each end from `first` on, the piece up to it that ends the path of the greatest score, among the pieces
        that may stand next to the last one before them. Pieces are found from behind, by the trie of reversed pieces."""
        ends, n, meets, pieces, values, bpe = self.ends, len(self.decoded), may_meet.get, self.pieces, self.values, self.bpe
        for end in range(first, len(word) + 1):
            node, k, top, at, found = ends, end, None, end - 1, -1
            while k:
                k -= 1
                node = node.get(word[k])
                if node is None:
                    break
                i = node.get("")
                if i is None:
                    continue
                total = score[k] + values[i]
                if top is not None and total < top:
                    continue
                if bpe and k and (left := last[k]) >= 0:  # nothing merges with a character without a piece
                    pair = left * n + i
                    fits = meets(pair)
                    if fits is None:
                        fits = may_meet[pair] = merged(pieces[left] + pieces[i], self.scores) == [pieces[left], pieces[i]]
                    if not fits:
                        continue
                top, at, found = total, k, i
            if top is None or (not bpe and word[end - 1] not in self.scores and score[end - 1] + self.unknown_score > top):
                top, at, found = score[end - 1] + self.unknown_score, end - 1, -1
            score.append(top)
            last.append(found)
            start.append(at)

    def decode(self, ids: list[int]) -> str:
        out = b"".join(map(self.decoded.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out


_words = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


def marked_words(text: str | None) -> list[str]:
    return _words.findall(MARK + text.replace(" ", MARK)) if text else []


def slices(texts: list[str | None], chars: int) -> Iterator[slice]:
    begin = total = 0
    for k, x in enumerate(texts):
        total += len(x or "")
        if total >= chars:
            yield slice(begin, k + 1)
            begin, total = k + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


ENCODED = "doc_id long, n_tokens long, n_byte_tokens long, path_score double, round_trip boolean, token_ids array<int>"


def encode(docs: DataFrame, vocabulary: Vocabulary, cache_words: int = 500_000, slice_chars: int = 2_000_000) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, path_score (of the best path, all words together), round_trip (decoding the ids
    gave the text) and token_ids of every row."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_byte_tokens", pa.int64()), ("path_score", pa.float64()), ("round_trip", pa.bool_()), ("token_ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        is_byte = np.zeros(len(v.decoded), bool)
        is_byte[v.byte_ids] = True
        values = np.array(v.values)
        for batch in batches:
            for part in slices(texts := batch["text"].to_pylist(), slice_chars):
                texts_here = texts[part]
                words = [marked_words(x) for x in texts_here]
                known = v.ids_of(set().union(*words), cache_words)
                ids = [np.frombuffer(b"".join(map(known.__getitem__, x)), np.int32) for x in words]
                del words
                sizes = np.array([len(x) for x in ids], np.int64)
                flat = np.concatenate([np.empty(0, np.int32), *ids])
                ends = np.concatenate([[0], np.cumsum(sizes)])
                in_bytes = np.concatenate([[0], np.cumsum(is_byte[flat])])
                back = [v.decode(x.tolist()) == (t or "") for x, t in zip(ids, texts_here)]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch["doc_id"][part], pa.array(sizes), pa.array(in_bytes[ends[1:]] - in_bytes[ends[:-1]]), pa.array([float(values[x].sum()) for x in ids], pa.float64()), pa.array(back), lists], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and text of every row of (doc_id, token_ids); null ids give the empty text."""
    held = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        for batch in batches:
            texts = [v.decode(x.as_py() or []) for x in batch["token_ids"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "token_ids").mapInArrow(run, "doc_id long, text string")

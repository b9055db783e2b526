"""Token counts by a map-side two-tier lookup, without a shuffle of pre-tokens.

First tier: one compact table of the frequent pre-tokens' token counts, broadcast.  It is fitted on a sample of some
SAMPLE_TEXTS texts, however many there are: tasks count the pre-tokens of the sample's texts that they hold and send the most frequent
ones, whose sums are cut to the table's size.  Second tier: each worker's cache of the other pre-tokens, filled by the tokenizer and
emptied when full.  The table only saves time; any table gives the same counts.

Pre-tokens are runs of spaces with the characters up to the next space.  No piece of the vocabulary has a space after
another character (checked when the model is loaded) and the normalizer leaves texts as they are, so no merge crosses
such a border and the counts of the pre-tokens add up.  Other models are encoded whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Entries of the broadcast table and the longest pre-token in it (UTF-8 bytes): at most 2 MB in all.
TABLE_SIZE = 32_768
TABLE_BYTES = 48
#: Texts of the sample that the table is fitted on, about.
SAMPLE_TEXTS = 4_096
#: Counters of one task, and how many it sends.
TASK_COUNTERS = 200_000
TASK_SENDS = 4_096
#: Entries of a worker's cache, and the longest pre-token in it.
CACHE_SIZE = 400_000
CACHE_CHARS = 200

_loaded: dict = {}
_caches: dict = {}


def pieces_model(path: str):
    """The sentencepiece model at ``path``, and whether pre-tokens can be counted apart."""
    if path not in _loaded:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model.serialized_model_proto())
        n = spec.normalizer_spec
        apart = n.name == "identity" and n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces and not spec.trainer_spec.treat_whitespace_as_suffix
        apart = apart and not any(p.type == 4 or re.search("[^▁]▁", p.piece) for p in spec.pieces)
        _loaded[path] = (model, apart)
    return _loaded[path]


def pretokens(text: str) -> list[str]:
    """The text with the model's leading space, cut before each run of spaces; the leading space of each cut is left out.

    A text that holds the model's own mark for a space is one piece: the mark and a space are the same symbol there.
    """
    if "▁" in text:
        return [text]
    words = text.split(" ")
    if "" not in words:
        return words
    out, spaces = [], 0
    for k, w in enumerate(words):
        if w or k == len(words) - 1:
            out.append(" " * spaces + w)
            spaces = 0
        else:
            spaces += 1
    return out


def _texts(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for i in range(batch.num_rows):
            yield ids[i].as_py(), texts[i].as_py() or ""


def _heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's most frequent pre-tokens, from bounded counters (halved and thinned when full)."""
    counts: Counter = Counter()
    for batch in batches:
        for value in batch.column(0):
            counts.update(pretokens(value.as_py() or ""))
            if len(counts) > TASK_COUNTERS:
                counts = Counter(dict(counts.most_common(TASK_COUNTERS // 4)))
    top = [(w, n) for w, n in counts.most_common(TASK_SENDS) if len(w.encode("utf-8", "replace")) <= TABLE_BYTES]
    yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})


def frequent_table(docs: DataFrame, path: str, text: str = "text") -> dict[str, int]:
    """The most frequent pre-tokens of a sample of the texts with their token counts.

    Nothing is shuffled; what reaches the driver is bounded by the words of the sample."""
    share = min(1.0, SAMPLE_TEXTS / max(docs.count(), 1))
    counts: Counter = Counter()
    for r in docs.select(text).sample(share, seed=6).mapInArrow(_heavy, "word string, n long").collect():
        counts[r.word] += r.n
    model, _ = pieces_model(path)
    words = sorted(counts, key=lambda w: (-counts[w], w))[:TABLE_SIZE]
    return dict(zip(words, map(len, model.encode(words, num_threads=1)), strict=True)) if words else {}


def counter(path: str, table: dict[str, int]) -> Callable[[str], int]:
    """A function that counts a text's tokens; its second-tier cache lives as long as the worker."""
    model, apart = pieces_model(path)
    if not apart:
        return lambda text: len(model.encode(text, num_threads=1))
    caches = _caches

    def count(text: str) -> int:
        if not text:
            return 0
        words = pretokens(text)
        if len(words) == 1:
            return len(model.encode(text, num_threads=1))
        cache = caches.setdefault(path, {"": 1})  # an empty pre-token stands after a last space, and is that space
        found = [table.get(w) or cache.get(w) for w in words]
        if None in found:
            missed = [*{w for w, n in zip(words, found, strict=True) if n is None}]
            sizes = dict(zip(missed, map(len, model.encode(missed, num_threads=1)), strict=True))
            if len(cache) > CACHE_SIZE:
                caches[path] = cache = {"": 1}
            cache.update((w, n) for w, n in sizes.items() if len(w) <= CACHE_CHARS)
            found = [sizes[w] if n is None else n for w, n in zip(words, found, strict=True)]
        return sum(found)

    return count


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens (long) and over_limit of every row.  Null and empty texts have no tokens; rows repeat as
    in the input; an empty table gives an empty result; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_table(docs, path, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, shared.value)
        for batch in batches:
            rows = [(len(t.encode()), count(t)) for _, t in _texts(iter([batch]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[1] > limit for r in rows], pa.bool_())], names=[doc_id, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


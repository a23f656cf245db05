"""Benchmark decontamination with a generalised suffix automaton.

The words of the test items (A-Z lower-cased, runs of letters, digits and non-ASCII characters)
form a generalised suffix automaton.  A document's words stream through it, and the automaton
tracks the longest stretch ending at each word that occurs in an item.  Where that length reaches
``window`` words, those words are hit; an item shorter than a window is hit where it occurs whole.

The items are dealt by id and text into blocks of about ``block_words`` words, each automaton is built in a task of
its own and written to the shared folder, and a worker loads one block's automaton at a time, so memory is bounded by a block (or
one item, if that is longer) however many items there are and however many share an id.  Nothing of them passes the driver but the
names of the files, and nothing is broadcast.  With several blocks, a task reads each once per ``_CHUNK`` bytes of texts.  The
shared folder must be one that pyarrow opens too (a mounted path, hdfs, s3, gs).

Null and wordless texts have no words and no hits; items that are null, wordless or without an id
are left out; repeated items count once; items of equal text are all hit, listed by id; an empty item table hits nothing.
Documents are read whole, rows are independent, so repeated rows have equal results.  Extra columns are kept under whatever
names; ``with_overlap`` replaces a column ``overlap``, and ``decontaminate`` changes ``text`` and ``n_chars`` only.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkproof.llm.shared import binary_text, fresh, shared_dir

#: Bytes of texts that are held while the blocks are read one after the other; changes the speed only.
_CHUNK = 32 << 20

#: UTF-8 form of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


class Automaton(NamedTuple):
    vocabulary: dict[bytes, int]
    step: list[dict[int, int]]  # transitions of each state
    link: list[int]  # suffix links
    length: list[int]  # longest stretch of each state
    window: int
    at_window: list[int]  # the state of the last `window` words, -1 if the state is shorter
    items: dict[int, list[int]]  # items of the window that a state stands for
    short: dict[int, list[tuple[int, int]]]  # (words, item) of short items that end in a state


def _insert(step: list, link: list, length: list, last: int, word: int) -> int:
    """Extend the path that ends in ``last`` by a word; the state of the extended path."""
    known = step[last].get(word)
    if known is not None and length[known] == length[last] + 1:
        return known
    if known is not None:
        return _split(step, link, length, last, word, known)
    new = len(step)
    step.append({})
    length.append(length[last] + 1)
    link.append(0)
    at = last
    while at >= 0 and word not in step[at]:
        step[at][word] = new
        at = link[at]
    if at >= 0:
        target = step[at][word]
        link[new] = target if length[target] == length[at] + 1 else _split(step, link, length, at, word, target)
    return new


def _split(step: list, link: list, length: list, at: int, word: int, target: int) -> int:
    """The state of the shorter stretches of ``target``, which get a state of their own."""
    clone = len(step)
    step.append(dict(step[target]))
    length.append(length[at] + 1)
    link.append(link[target])
    link[target] = clone
    while at >= 0 and step[at].get(word) == target:
        step[at][word] = clone
        at = link[at]
    return clone


def build(items: dict[int, list[bytes]], window: int) -> Automaton:
    """The automaton of items given as id → words."""
    vocabulary: dict[bytes, int] = {}
    coded = {k: [vocabulary.setdefault(w, len(vocabulary)) for w in v] for k, v in sorted(items.items()) if v}
    step, link, length = [{}], [-1], [0]
    for item in coded.values():
        last = 0
        for word in item:
            last = _insert(step, link, length, last, word)
    at_window = [-1] * len(step)
    for state in sorted(range(len(step)), key=length.__getitem__):
        if length[state] >= window:
            parent = link[state]
            at_window[state] = at_window[parent] if length[parent] >= window else state
    found: dict[int, list[int]] = {}
    ends: dict[int, list[tuple[int, int]]] = {}
    for key, item in coded.items():
        state = 0
        for n, word in enumerate(item, 1):
            state = step[state][word]
            if n >= window and key not in found.setdefault(at_window[state], []):
                found[at_window[state]].append(key)
        if len(item) < window:
            ends.setdefault(state, []).append((len(item), key))
    short: dict[int, list[tuple[int, int]]] = {}
    if ends:
        for state in sorted(range(1, len(step)), key=length.__getitem__):
            mine = [*ends.get(state, []), *short.get(link[state], [])]
            if mine:
                short[state] = mine
    return Automaton(vocabulary, step, link, length, window, at_window, found, short)


def matches(automaton: Automaton, document: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
    """The hit stretches as (first word, end word), merged and in order, and the items hit."""
    coded = map(automaton.vocabulary.get, document)
    _, step, link, length, window, at_window, items, short = automaton
    spans: list[list[int]] = []
    hit: set[int] = set()
    state = reach = 0
    for n, word in enumerate(coded, 1):
        if word is None:
            state = reach = 0
            continue
        following = step[state].get(word)
        while following is None and state:
            state = link[state]
            reach = length[state]
            following = step[state].get(word)
        state = following or 0
        reach = reach + 1 if following else 0
        size = 0
        if reach >= window:
            size = reach
            hit.update(items[at_window[state]])
        if short and state in short:
            for many, key in short[state]:
                if many <= reach:
                    hit.add(key)
                    size = max(size, many)
        if size:
            start = n - size
            while spans and spans[-1][0] >= start:
                spans.pop()
            if spans and spans[-1][1] >= start:
                spans[-1][1] = n
            else:
                spans.append([start, n])
    return [(a, b) for a, b in spans], hit


def automata(items: DataFrame, window: int, block_words: int) -> list[str]:
    """Files of the shared folder with the packed automaton of each block of items (item_id, text)."""
    if block_words < 1 or window < 1:
        raise ValueError("window and block_words must be positive")
    kept = items.select("item_id", binary_text().alias("text")).where("item_id is not null").distinct()
    # a word has at least one byte and a byte after it, so bytes / 2 bounds the words
    total = kept.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = 1 + total // (2 * block_words)

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        by_item: dict[int, list[bytes]] = {}
        for n, (key, text) in enumerate(zip(frame["item_id"], frame["text"])):
            by_item[(int(key), n)] = words(bytes(text))
        return pd.DataFrame({"automaton": [pickle.dumps(_renamed(build(by_item, window)))]})

    # by the text too: an id may come with any number of texts
    dealt = kept.groupBy(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("block"))
    packed = dealt.applyInPandas(pack, "automaton binary")
    path = f"{shared_dir(items.sparkSession)}/automata-{uuid.uuid4().hex}"
    packed.write.option("maxRecordsPerFile", 1).parquet(path)
    return sorted(items.sparkSession.read.schema("automaton binary").parquet(path).inputFiles())


@lru_cache(maxsize=1)
def _loaded(file: str) -> Automaton | None:
    """One per Python worker: the automaton of a file, none in an empty one."""
    where, path = pa.fs.FileSystem.from_uri(file.replace("s3a://", "s3://", 1))
    with where.open_input_file(path) as source:
        rows = pq.read_table(source)["automaton"]
    return pickle.loads(rows[0].as_py()) if len(rows) else None


def _renamed(automaton: Automaton) -> Automaton:
    """Items keyed by (id, row) become ids: texts that share an id stay apart until here."""
    return automaton._replace(
        items={s: [k for k, _ in keys] for s, keys in automaton.items.items()},
        short={s: [(n, k) for n, (k, _) in ends] for s, ends in automaton.short.items()},
    )


_RESULT = "struct<n_words:bigint,n_hit:bigint,item_ids:array<bigint>,spans:array<struct<start:int,end:int>>>"
_RESULT_TYPE = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("item_ids", pa.list_(pa.int64())),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ]
)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _places(text: bytes, spans: list[tuple[int, int]]) -> list[dict]:
    """Word spans as spans of code points."""
    if not spans:
        return []
    bounds = [m.span() for m in _WORD.finditer(text.lower())]
    out, at, seen = [], 0, 0
    for first, end in spans:
        a, b = bounds[first][0], bounds[end - 1][1]
        start = seen + len(text[at:a].decode("utf-8", "replace"))
        seen = start + len(text[a:b].decode("utf-8", "replace"))
        at = b
        out.append({"start": start, "end": seen})
    return out


def _chunks(batches: Iterator[pa.Array]) -> Iterator[list[pa.Array]]:
    """Batches gathered to about ``_CHUNK`` bytes, a batch at least."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= _CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def overlap(text: Column, blocks: list[str]) -> Column:
    """Per whole text (binary): words, hit words, ids of the items hit, and the spans hit in code points."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # with one block there is nothing to gather texts for
        for chunk in _chunks(batches) if len(blocks) > 1 else ([b] for b in batches):
            found = [[(0, [], set())] * len(batch) for batch in chunk]
            for block in blocks:
                automaton = _loaded(block)
                for batch, mine in zip(chunk, found) if automaton else ():
                    for at in range(0, len(batch), 64):
                        for n, value in enumerate(batch[at : at + 64].to_pylist(), at):
                            document = words(value)
                            spans, hit = matches(automaton, document)
                            _, before, items = mine[n]
                            mine[n] = (len(document), before + spans, items | hit)
            for batch, mine in zip(chunk, found):
                done = []
                for n, (many, spans, items) in enumerate(mine):
                    spans = _merged(spans)
                    done.append(
                        {
                            "n_words": many or len(words(batch[n].as_py())),
                            "n_hit": sum(b - a for a, b in spans),
                            "item_ids": sorted(items),
                            "spans": _places(batch[n].as_py(), spans) if spans else [],
                        }
                    )
                yield pa.array(done, _RESULT_TYPE)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, _RESULT)(text)


def with_overlap(docs: DataFrame, items: DataFrame, window: int = 10, block_words: int = 50_000) -> DataFrame:
    """Documents with the column ``overlap`` (replacing one of that name)."""
    return docs.withColumn("overlap", overlap(binary_text(), automata(items, window, block_words)))


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5, block_words: int = 50_000
) -> DataFrame:
    """Documents without the spans they share with test items.

    A document of whose words more than ``max_coverage`` are hit goes; from the others the hit spans
    are cut out, and ``n_chars`` is counted anew.  Documents without a hit stay as they are.
    """
    found = fresh(docs, "found")
    marked = docs.withColumn(found, overlap(binary_text(), automata(items, window, block_words)))
    few = F.col(found)["n_hit"] <= F.col(found)["n_words"] * F.lit(max_coverage)
    return cut_spans(marked.where(few), found).select(docs.columns)


def cut_spans(marked: DataFrame, found: str = "overlap") -> DataFrame:
    """Cut the spans of the column ``found`` out of ``text``."""
    spans = F.col(found)["spans"]
    pieces = F.transform(
        spans,
        lambda s, n: F.substring(
            F.col("text"),
            F.when(n == 0, 0).otherwise(F.get(spans, n - 1)["end"]) + 1,
            s["start"] - F.when(n == 0, 0).otherwise(F.get(spans, n - 1)["end"]),
        ),
    )
    tail = F.substring(F.col("text"), F.element_at(spans, -1)["end"] + 1, F.char_length("text"))
    text = F.when(F.size(spans) > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col("text"))
    done = marked.withColumn("text", text)
    if "n_chars" not in marked.columns:
        return done
    return done.withColumn("n_chars", F.when(F.size(spans) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))

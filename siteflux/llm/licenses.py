"""Find licence texts: an exact set-similarity join of text blocks with licence templates, and known phrases."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Share of a template's distinct words that a block must hold.
PERCENT = 80
#: Words of a window over line ends, in percent of a template's words.
WINDOW = 150
#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Public licence notices, in normalised words, with their labels.
TEMPLATES = (
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

_ASCII = bytes.maketrans(
    bytes(b for b in range(128) if not chr(b).isalnum() and b != 10) + bytes(range(65, 91)),
    b" " * sum(not chr(b).isalnum() and b != 10 for b in range(128)) + bytes(range(97, 123)),
)


def normalised(text: str | None) -> bytes:
    """Lower-cased A-Z, other ASCII but digits and line ends as spaces; what lies beyond ASCII belongs to words."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_ASCII)


def _token_counts(docs: DataFrame, tokens: frozenset[bytes]) -> dict[bytes, int]:
    """In how many blocks of all documents each of the templates' words stands. One number per word is collected."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = dict.fromkeys(tokens, 0)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for block in normalised(text).split(b"\n"):
                    for token in tokens.intersection(block.split()):
                        seen[token] += 1
        yield pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

    found = docs.select("text").mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {bytes(r["token"]): r["n"] for r in found.collect()}


class TemplateIndex:
    """Templates by the rarest words of each, for blocks that hold at least ``percent`` of a template's words.

    A block that does must hold one of the template's first words in the common order, rarest first, as many as may
    be missing plus one. From the place of the first one it holds, the words after it bound the overlap.
    """

    def __init__(self, templates, counts: dict[bytes, int], percent: int):
        self.templates, self.windows, self.percent = [], [], percent
        self.first: dict[bytes, list[int]] = {}
        for label, text in templates:
            words = sorted(set(normalised(text).split()), key=lambda w: (counts.get(w, 0), w))
            need = -(-len(words) * percent // 100)
            for word in words[: len(words) - need + 1]:
                self.first.setdefault(word, []).append(len(self.templates))
            self.templates.append((label, words, need))
            self.windows.append(-(-len(normalised(text).split()) * WINDOW // 100))
        self.starts = frozenset(self.first)

    def matches(self, block: bytes) -> list[tuple[int, int]]:
        """(template, overlap) of every template the block contains to the threshold."""
        words = set(block.split())
        out = []
        for t in sorted({t for w in self.starts.intersection(words) for t in self.first[w]}):
            _, template, need = self.templates[t]
            if len(words) < need:
                continue
            place = next(i for i, w in enumerate(template) if w in words)
            if len(template) - place < need:
                continue
            overlap = sum(w in words for w in template[place:])
            if overlap >= need:
                out.append((t, overlap))
        return out


    def runs(self, words: list[bytes], t: int) -> list[tuple[int, int, int]]:
        """(first word, last word, overlap) of the windows that hold enough of template ``t``: the best of each cluster."""
        _, template, need = self.templates[t]
        own, size = frozenset(template), self.windows[t]
        places = [i for i, w in enumerate(words) if w in own]
        held: dict[bytes, int] = {}
        out, left, reach = [], 0, -1
        for place in places:
            held[words[place]] = held.get(words[place], 0) + 1
            while places[left] <= place - size or held[words[places[left]]] > 1:
                old = words[places[left]]
                held[old] -= 1
                if not held[old]:
                    del held[old]
                left += 1
            if len(held) >= need:
                best = (places[left], place, len(held))
                if places[left] > reach:
                    out.append(best)
                elif best[2] > out[-1][2]:
                    out[-1] = best
                reach = place
        return out

    def blocks(self, data: bytes, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(line, template, overlap): lines, then paragraphs and windows over line ends that hold no block found before.

        A text that does not hold enough of a template as a whole has no block that does.
        """
        whole = self.matches(data)
        if not whole:
            return []
        lines = data.split(b"\n")
        out = [(i, t, n) for i, line in enumerate(lines) for t, n in self.matches(line)]
        if len(lines) == 1:
            return out
        sizes = [len(line.split()) for line in lines]
        known: dict[int, list[tuple[int, int]]] = {}
        for i, t, _ in out:
            known.setdefault(t, []).append((i, i))

        def add(first: int, last: int, t: int, n: int) -> None:
            if not any(a <= last and first <= b for a, b in known.get(t, ())):
                out.append((first, t, n))
                known.setdefault(t, []).append((first, last))

        line_of = [i for i, n in enumerate(sizes) for _ in range(n)]
        for t, _ in whole:
            for start, end, n in self.runs(words, t):
                add(line_of[start], line_of[end], t, n)
        start = 0
        for end in range(len(lines) + 1):
            if end == len(lines) or not sizes[end]:
                if end - start > 1:
                    for t, n in self.matches(b" ".join(lines[start:end])):
                        add(start, end - 1, t, n)
                start = end + 1
        return out


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases: dict[str, str] = PHRASES, percent: int = PERCENT) -> DataFrame:
    """Every licence text and phrase of every document.

    One row per row: ``doc_id, n_words, phrases`` (label and first word of every place where a phrase's words stand
    one after the other), ``blocks`` (first line number, template number, label, containment of every block that holds
    ``percent`` of a template's distinct words) and ``score``: 1 if a phrase stands in the text, else the largest
    containment found, else 0. Words are maximal runs of a-z, 0-9 and characters beyond ASCII, after lower-casing
    A-Z. Blocks are lines; where no line of them holds the template, also windows over line ends of ``WINDOW`` percent of
    the template's words, and paragraphs between blank lines. Phrases may run over line ends.

    The templates are the bounded side of the join, given in the call; texts are read whole where they lie, repeats
    and nulls (empty: no words, score 0) each by themselves. The order of template words comes from counts over all
    documents and changes the work, not the result.
    """
    tokens = frozenset(w for _, text in templates for w in normalised(text).split())
    index = TemplateIndex(templates, _token_counts(docs, tokens), percent)
    sought = [(b" %s " % b" ".join(normalised(p).split()), label) for p, label in phrases.items()]
    rarest = [(p, label, max(p.split(), key=len)) for p, label in sought]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.struct([("label", pa.string()), ("word", pa.int64())])
        block = pa.struct([("line", pa.int64()), ("template", pa.int32()), ("label", pa.string()), ("containment", pa.float64())])
        for batch in batches:
            sizes, places, blocks, scores = [], [], [], []
            for text in batch.column(1).to_pylist():
                data = normalised(text)
                words = data.split()
                joined, here, found = None, [], []
                for phrase, label, part in rarest:
                    if part in data:
                        joined = joined or b" %s " % b" ".join(words)
                        at, before, passed = joined.find(phrase), 0, 0
                        while at >= 0:
                            before, passed = before + joined.count(b" ", passed, at), at
                            here.append({"label": label, "word": before})
                            at = joined.find(phrase, at + 1)
                if not index.starts.isdisjoint(words):
                    for line, t, overlap in index.blocks(data, words):
                        label, template, _ = index.templates[t]
                        found.append({"line": line, "template": t, "label": label, "containment": overlap / len(template)})
                sizes.append(len(words)), places.append(here), blocks.append(found)
                scores.append(1.0 if here else max((f["containment"] for f in found), default=0.0))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(places, pa.list_(place))]
            columns += [pa.array(blocks, pa.list_(block)), pa.array(scores, pa.float64())]
            yield pa.record_batch(columns, ["doc_id", "n_words", "phrases", "blocks", "score"])

    schema = (
        "doc_id long, n_words long, phrases array<struct<label:string,word:bigint>>, "
        "blocks array<struct<line:bigint,template:int,label:string,containment:double>>, score double"
    )
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, schema)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.array_sort(F.array_distinct("phrases.label"))
    labels = F.array_sort(F.array_distinct(F.concat("phrases.label", "blocks.label")))
    return out.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min("phrases.word").alias("first_word"),
        F.array_max("phrases.word").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        "score",
    )

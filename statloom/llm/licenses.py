"""License scans by template markup.

A template is wording with marked regions: ``<<optional>> ... <<end>>`` may be
missing, ``<<any N>>`` stands for up to N words of any kind.  Each template is
compiled into a token automaton; started wherever its opening words stand, it
accepts if all mandatory wording follows exactly, with optional wording whole
or absent.  Plain phrases are templates without regions.

Words are runs of ASCII letters and digits and of anything not ASCII,
lower-cased, so punctuation, markup and line breaks do not matter.

Cases: a null or empty text has no words and no hits; long texts are scanned
whole; overlapping places all count; repeated rows give repeated results; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import doc_texts

#: Every byte that belongs to no word becomes a space; A-Z become a-z; other bytes are kept.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Templates: label, wording with marked regions.
TEMPLATES = (
    ("mit-notice", "released under the mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
     "associated documentation files <<optional>> the software <<end>> to deal in the software without restriction "
     "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
     "copies of the software"),
    ("apache-2.0-notice", "licensed under the apache license version 2 0 <<optional>> the license <<end>>"),
    ("apache-2.0-text", "you may not use <<any 3>> file <<any 3>> except in compliance with the license <<optional>> you "
     "may obtain a copy of the license at <<any 8>> <<end>> unless required by applicable law or agreed to in writing "
     "software distributed under the license is distributed on an as is basis"),
    ("gpl-notice", "licensed under the gnu <<optional>> lesser <<end>> general public license <<optional>> as published "
     "by the free software foundation <<end>> version <<any 1>>"),
    ("gpl-text", "you can redistribute it and or modify it under the terms of the gnu <<optional>> lesser <<end>> "
     "general public license as published by the free software foundation either version <<any 4>> of the license "
     "<<optional>> or at your option any later version <<end>>"),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted "
     "provided that the following conditions are met <<any 12>> redistributions of source code must retain the above "
     "copyright notice this list of conditions and the following disclaimer"),
    ("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
     "hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2.0-notice", "this source code form is subject to the terms of the mozilla public license v <<any 1>> 2 0"),
    ("unlicense-text", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc-notice", "licensed under <<optional>> a <<end>> <<optional>> the <<end>> <<optional>> creative commons "
     "<<end>> cc by nc <<optional>> 4 0 <<end>>"),
    ("cc-notice", "licensed under <<optional>> a <<end>> <<optional>> the <<end>> creative commons attribution "
     "<<optional>> noncommercial <<end>> <<optional>> non commercial <<end>> <<optional>> sharealike <<end>> "
     "<<any 2>> <<optional>> international <<end>> <<optional>> public <<end>> license"),
)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8").translate(WORDS).split()


@dataclass
class Automaton:
    """States of one template: word edges, wildcard edges, free edges, mandatory words behind each state."""

    label: str
    base: bool
    edges: list[dict] = field(default_factory=list)
    wild: list[list] = field(default_factory=list)
    free: list[list] = field(default_factory=list)
    done: list[int] = field(default_factory=list)
    end: int = 0
    opening: bytes = b""

    def state(self, done: int) -> int:
        self.edges.append({})
        self.wild.append([])
        self.free.append([])
        self.done.append(done)
        return len(self.edges) - 1

    def closed(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def run(self, words: list[bytes], at: int) -> tuple[int, float]:
        """Words of the longest accepted stretch from ``at`` (-1: none), and the share of mandatory words met."""
        now, length, best = self.closed([0]), -1, 0
        for k in range(at, len(words)):
            w = words[k]
            nxt = {t for s in now for t in (*self.edges[s].get(w, ()), *self.wild[s])}
            if not nxt:
                break
            now = self.closed(nxt)
            best = max(best, max(self.done[s] for s in now))
            if self.end in now:
                length = k + 1 - at
        return length, best / max(1, self.done[self.end])


def compiled(label: str, wording: str, base: bool = False) -> Automaton:
    a = Automaton(label, base)
    at, opened, opening = a.state(0), [], []
    plain = True
    for mark, text in re.findall(r"<<(\w+(?: \d+)?)>>|([^<]+)", wording):
        if mark == "optional":
            opened.append(at)
            plain = False
        elif mark == "end":
            start = opened.pop()
            last = a.state(a.done[start])
            a.free[at].append(last)
            a.free[start].append(last)
            at = last
        elif mark:
            plain = False
            last = a.state(a.done[at])
            for _ in range(int(mark.split()[1])):
                a.free[at].append(last)
                nxt = a.state(a.done[at])
                a.wild[at].append(nxt)
                at = nxt
            a.free[at].append(last)
            at = last
        else:
            for w in words_of(text):
                nxt = a.state(a.done[at] + (not opened))
                a.edges[at].setdefault(w, []).append(nxt)
                at = nxt
                if plain:
                    opening.append(w)
    a.end = at
    a.opening = b" " + b" ".join(opening[:4]) + b" "
    if not opening:
        raise ValueError(f"template {label} must open with mandatory words")
    return a


def hits_of(words: list[bytes], automata: list[Automaton]) -> list[tuple]:
    """(label, base, start, words, share) of every place where a template opens."""
    text = b" " + b" ".join(words) + b" "
    out = []
    for a in automata:
        at = text.find(a.opening)
        word, counted = 0, 0
        while at >= 0:
            word += text.count(b" ", counted, at)
            counted = at
            length, share = a.run(words, word)
            out.append((a.label, a.base, word, max(length, 0), 1.0 if length >= 0 else min(share, 0.999)))
            at = text.find(a.opening, at + 1)
    return out


HIT = "struct<label:string,base:boolean,start:bigint,words:bigint,share:double>"


def scan(docs: DataFrame, base: dict[str, str] = BASE, templates=TEMPLATES, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """doc_id, n_words, hits (accepted ones have share 1) of every whole text."""
    automata = [compiled(label, phrase, True) for phrase, label in base.items()]
    automata += [compiled(label, wording) for label, wording in templates]
    kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()),
                               ("words", pa.int64()), ("share", pa.float64())]))
    names = ("label", "base", "start", "words", "share")

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sizes, hits = [], []
                for t in part.column(1).to_pylist():
                    ws = words_of(t)
                    sizes.append(len(ws))
                    hits.append([dict(zip(names, h)) for h in hits_of(ws, automata)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(hits, kind)],
                                                 names=["doc_id", "n_words", "hits"])

    return doc_texts(docs, id_col, text_col).mapInArrow(run, f"doc_id long, n_words long, hits array<{HIT}>")


def summary(scanned: DataFrame) -> DataFrame:
    """Counts, first and last place of the base phrases, labels and score of every document."""
    accepted = F.filter("hits", lambda h: h["share"] == 1.0)
    df = scanned.select("doc_id", "n_words", "hits", accepted.alias("ok")).withColumn(
        "base", F.filter("ok", lambda h: h["base"]))

    def joined(hits):
        return F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))))

    starts = F.transform("base", lambda h: h["start"])
    return df.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
                     F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                     joined(F.col("base")).alias("base_labels"), joined(F.col("ok")).alias("labels"),
                     F.coalesce(F.array_max(F.transform("hits", lambda h: h["share"])), F.lit(0.0)).alias("score"))

"""License notices found by MinHash over overlapping windows, verified by shingle containment.

Words are runs of letters, digits and bytes above 0x7F, folded; shingles are five words. A text's
shingles are cut into blocks; a window is two neighboring blocks, so a notice no longer than a
block lies whole in some window. Each notice is looked for at the smallest block size (4 times a
power of two) that holds it: of a window's distinct shingles at least one in eight is then the
notice's (three in sixteen for one that is three quarters there), and with 64 bands of one sample
a window misses its notice with a probability under 2e-4. A window that shares a sample is
verified: at least three quarters of the notice's shingles must stand in it or the block beside.

Defined cases. Null, empty and short texts hold nothing and give no row. Null ids are carried.
Repeated rows give their rows each. Several notices in a text give a row each; one found at several
places gives one row, with the best containment and the first place of that. Empty table: no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipscan.llm import text as X
from dipscan.llm.minhash import _samples

#: Notices as their licenses ask for them (fixed values).
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

_GAPS = np.ones(256, bool)
_GAPS[48:58] = _GAPS[65:91] = _GAPS[97:123] = _GAPS[128:] = False


@dataclass(frozen=True)
class Scan:
    samples: int = 64
    block: int = 4  # shingles of the smallest
    least_containment: float = 0.75
    words: int = 5


def _shingles(buf: np.ndarray, offs: np.ndarray, cfg: Scan) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, woffs = X.words(buf, offs, _GAPS)
    return X.shingles(X.word_hashes(buf, starts, ends), woffs, cfg.words)


class _Index:
    """The notices' shingles and, for each block size, their samples; as large as the list of notices."""

    def __init__(self, notices, cfg: Scan):
        buf, offs = X.flat(pa.array([t for _, t in notices]))
        values, soffs = _shingles(buf, offs, cfg)
        self.names = [n for n, _ in notices]
        self.sets = [np.unique(values[a:b]) for a, b in zip(soffs[:-1], soffs[1:], strict=True)]
        self.sizes: dict[int, list[int]] = {}
        for t, s in enumerate(self.sets):
            size = cfg.block
            while size < len(s):
                size *= 2
            self.sizes.setdefault(size, []).append(t)
        self.samples, self.marked = {}, {}
        for size, of in self.sizes.items():
            flat = np.concatenate([self.sets[t] for t in of])
            at = np.r_[0, np.cumsum([len(self.sets[t]) for t in of])[:-1]]
            self.samples[size] = _samples(flat, at, cfg.samples, 41)
            self.marked[size] = np.zeros((cfg.samples, 1 << 16), bool)
            for k in range(cfg.samples):
                self.marked[size][k, self.samples[size][k] & 0xFFFF] = True


def _pieces(offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of blocks of ``size`` and the documents' offsets into the blocks."""
    count = -(-np.diff(offs) // size)
    boffs = np.r_[0, np.cumsum(count)]
    return np.arange(boffs[-1]) * size + np.repeat(offs[:-1] - boffs[:-1] * size, count), boffs


def _hits(values: np.ndarray, offs: np.ndarray, index: _Index, cfg: Scan):
    """(document, notice, containment, first shingle) of every verified window."""
    if not len(values):
        return
    base, boffs = _pieces(offs, cfg.block)
    minima = _samples(values, base, cfg.samples, 41)
    for size, of in sorted(index.sizes.items()):
        starts, woffs = _pieces(boffs, size // cfg.block)
        met = np.zeros(len(starts), bool)
        last = np.zeros(len(starts), bool)
        last[woffs[1:][np.diff(woffs) > 0] - 1] = True
        for k in range(cfg.samples):
            low = minima[k] if size == cfg.block else np.minimum.reduceat(minima[k], starts)
            window = low.copy()
            window[:-1] = np.where(last[:-1], low[:-1], np.minimum(low[:-1], low[1:]))
            maybe = np.flatnonzero(index.marked[size][k, window & 0xFFFF])
            met[maybe[np.isin(window[maybe], index.samples[size][k])]] = True
        for w in np.flatnonzero(met):
            d = int(np.searchsorted(woffs, w, "right")) - 1
            place = (w - woffs[d]) * size
            a, b = offs[d] + max(0, place - size), min(offs[d] + place + 3 * size, offs[d + 1])
            near = values[a:b]
            for t in of:
                have = np.isin(index.sets[t], near)
                share = have.sum() / len(have)
                if share >= cfg.least_containment:
                    first = int(np.flatnonzero(np.isin(near, index.sets[t]))[0] + a - offs[d])
                    yield d, t, share, first


def _scanner(notices, cfg: Scan):
    schema = pa.schema([
        ("doc_id", pa.int64()), ("license", pa.string()), ("containment", pa.float64()), ("first_word", pa.int64())
    ])

    def run(batches):
        index = _Index(notices, cfg)
        for batch in batches:
            buf, offs = X.flat(batch.column(1))
            best: dict[tuple[int, str], tuple[float, int]] = {}
            for i, j in X.blocks(offs):
                values, soffs = _shingles(buf[offs[i]: offs[j]], offs[i: j + 1] - offs[i], cfg)
                for d, t, share, first in _hits(values, soffs, index, cfg):
                    key = (i + d, index.names[t])
                    if key not in best or (share, -first) > (best[key][0], -best[key][1]):
                        best[key] = (share, first)
            if best:
                keys = sorted(best)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array([k[0] for k in keys])), pa.array([k[1] for k in keys]),
                    pa.array([best[k][0] for k in keys], pa.float64()), pa.array([best[k][1] for k in keys], pa.int64()),
                ], schema=schema)

    return run


def licenses(docs: DataFrame, notices=NOTICES, cfg: Scan = Scan()) -> DataFrame:
    """doc_id, license, containment, first_word: one row per row of ``docs`` and license found in it."""
    two = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return two.mapInArrow(
        _scanner(tuple(notices), cfg), "doc_id long, license string, containment double, first_word long"
    )

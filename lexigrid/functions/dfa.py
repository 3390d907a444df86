"""Automata over columns: whole Arrow batches at a time, one gather for each character position."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrid.plans.automata import Dfa, encode


def accepts(dfa: Dfa, text: Column) -> Column:
    """Whether the automaton accepts the text."""

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        state = dfa.run(encode(texts.fillna("\0").tolist()))
        return pd.Series((state >= 0) & dfa.accept[np.maximum(state, 0)])

    return run(text)


def steps(dfa: Dfa, sources: list[int], text: Column) -> Column:
    """array<struct<source, target>>: where a text leads from each of the source states, if anywhere live."""
    live = dfa.live()

    @F.pandas_udf("array<struct<source:int,target:int>>")
    def run(texts: pd.Series) -> pd.Series:
        codes = encode(texts.fillna("\0").tolist())
        out: list[list[dict]] = [[] for _ in range(len(codes))]
        for q in sources:
            state = dfa.run(codes, q)
            for k in np.flatnonzero((state >= 0) & live[np.maximum(state, 0)]).tolist():
                out[k].append({"source": q, "target": int(state[k])})
        return pd.Series(out)

    return run(text)

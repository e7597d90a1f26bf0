"""Random streams that belong to a cell and not to a partition: equal in every run and for every layout of the data.

A cell's stream starts from its key's FNV-1a hash and a seed; SplitMix64 gives its numbers, of which 53 bits make a double.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the two public generators.
_FNV_START, _FNV_PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)
_GAMMA = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _fnv(keys: list[bytes]) -> np.ndarray:
    """All keys at once, one byte place after another."""
    length = np.array([len(k) for k in keys])
    width = int(length.max(initial=0))
    data = np.zeros((len(keys), width), np.uint8)
    for row, k in zip(data, keys, strict=True):
        row[: len(k)] = np.frombuffer(k, np.uint8)
    h = np.full(len(keys), _FNV_START)
    for j in range(width):
        h = np.where(length > j, (h ^ data[:, j].astype(np.uint64)) * _FNV_PRIME, h)
    return h


def uniform(keys: list[str], seed: int, draw: int = 0) -> np.ndarray:
    """Numbers in [0, 1) of the keys' streams at one draw."""
    with np.errstate(over="ignore"):
        state = _mix(np.array([seed], np.uint64)) ^ _mix(_fnv([k.encode() for k in keys]))
        return (_mix(state + _GAMMA * np.uint64(draw + 1)) >> np.uint64(11)).astype(float) / float(1 << 53)


@dataclass(frozen=True)
class Tick:
    """What one recalculation sees of the world: a time and a seed, the same for every cell of every sheet, so that a
    recalculation can be repeated."""

    serial: float
    seed: int

    def now(self) -> Column:
        return F.lit(self.serial)

    def today(self) -> Column:
        return F.lit(float(math.floor(self.serial)))

    def rand(self, key: Column, draw: int = 0) -> Column:
        return rand(key, self.seed, draw)

    def randbetween(self, key: Column, low: Column, high: Column, draw: int = 0) -> Column:
        """A whole number from low to high."""
        return low + F.floor(self.rand(key, draw) * (high - low + 1))


def rand(key: Column, seed: int, draw: int = 0) -> Column:
    """RAND() of the cell named by key."""

    @F.pandas_udf("double")
    def numbers(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in parts:
            yield pd.Series(uniform([k if k is not None else "" for k in keys], seed, draw))

    return numbers(key)

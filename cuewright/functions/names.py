"""Names in Chinese lines: known ones, and others by weighted signs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

SEPARATOR = " <sep> "


@dataclass(frozen=True)
class NameRules:
    """What speaks for a name, and against it. All are fixed values but ``known`` and ``never``."""

    threshold: int = 100
    # weights
    suffix: int = 60
    call: int = 40
    repeated: int = 40
    common_word: int = -30
    length: int = 10
    suffixes: tuple[str, ...] = ("哥", "姐", "老")
    times: int = 2
    common_words: tuple[str, ...] = ("到", "来", "走", "回", "看", "是", "有", "没", "了", "的", "在", "去")
    lengths: tuple[int, ...] = (1, 2, 3)
    no_end: tuple[str, ...] = ("了", "吗", "呢", "啊", "吧")
    # what no name is, holds or begins with
    exclaimed: tuple[str, ...] = ("哎", "哈", "哈哈", "嗯", "呃")
    particles: tuple[str, ...] = ("了", "吗", "呢", "吧", "啊")
    kin: tuple[str, ...] = ("师傅", "老师", "嫂子", "媳妇", "叔", "婶")
    pronouns: tuple[str, ...] = ("我", "你", "他", "她", "它", "我们", "你们", "他们")
    numbers: tuple[str, ...] = ("一", "二", "三", "十", "百", "千", "张", "条", "个", "岁")
    verbs: tuple[str, ...] = ("去", "来", "走", "回", "找", "看", "拿", "放", "别", "让", "给", "该", "接")
    edges: str = "，。！？、；： \t\n"
    old: str = "老"
    old_before: int = 1
    need_sign: bool = True
    known: frozenset[str] = frozenset()
    never: frozenset[str] = frozenset()

    @cached_property
    def _whole(self) -> frozenset[str]:
        return frozenset({*self.exclaimed, *self.particles, *self.kin, *self.never})

    @cached_property
    def _inside(self) -> tuple[str, ...]:
        return (*self.pronouns, *self.numbers, *(x for x in self.exclaimed if len(x) > 1))

    def excluded(self, word: str) -> bool:
        return word in self._whole or any(x in word for x in self._inside) or (len(word) > 1 and word.startswith(self.verbs))

    def sign(self, word: str, text: str, first: bool) -> bool:
        """Whether a word by itself could be a name: a call, a repeated word, or a short part before a suffix."""
        if 2 <= len(word) <= 3 and (first or text.count(word) >= self.times):
            return True
        parts = [(s, len(word) - len(s)) for s in self.suffixes if word.endswith(s)]
        return any(1 <= n <= (self.old_before if s == self.old else 3) for s, n in parts)

    def score(self, word: str, text: str, first: bool) -> int:
        return (
            self.suffix * word.endswith(self.suffixes)
            + self.call * first
            + self.repeated * (text.count(word) >= self.times)
            + self.common_word * (word in self.common_words)
            + self.length * (len(word) in self.lengths and not word.endswith(self.no_end))
        )

    def judged(self, word: str, text: str, first: bool, sure: bool) -> int | None:
        """The score of a name; null of another word. ``sure`` ones need no further sign."""
        if word in self.known:
            return 999
        score = self.score(word, text, first)  # cheaper than what excludes a word, and few reach the threshold
        if score < self.threshold or self.excluded(word) or (self.need_sign and not sure and not self.sign(word, text, first)):
            return None
        return score


_HAN = re.compile(r"[\u4e00-\u9fff]+")


def _windows(part: str, *sizes: int) -> Iterator[tuple[int, str]]:
    """Stretches of so many Chinese characters, side by side from the left, a size at a time."""
    for n in sizes:
        for run in _HAN.finditer(part):
            for at in range(run.start(), run.end() - n + 1, n):
                yield at, part[at : at + n]


def _found(part: str, text: str, rules: NameRules) -> list[tuple[bool, int, int, str]]:
    """(before a suffix, score, place, name): words with a suffix first, then words at an edge that meet none of those found."""
    found: list[tuple[bool, int, int, str]] = []
    for at, word in _windows(part, 4, 3):
        name = next((word[: -len(s)] for s in rules.suffixes if word.endswith(s)), "")
        score = rules.judged(name, text, at == 0, True) if name else None
        if score is not None:
            found.append((True, score, at, name))
    for at, word in _windows(part, 3, 2, 1):
        end = at + len(word)
        edge = at == 0 or part[at - 1] in rules.edges or (end < len(part) and part[end] in rules.edges)
        if not (edge or word in rules.known) or word.endswith(rules.suffixes) or any(at < a + len(n) and a < end for _, _, a, n in found):
            continue
        score = rules.judged(word, text, at == 0, False)
        if score is not None:
            found.append((False, score, at, word))
    return sorted(found, key=lambda f: (not f[0], -f[1], f[2]))


def masked(text: str, rules: NameRules) -> tuple[str, list[str]]:
    """A text (parts between separators) with its names as <<NAME_i>>, and the names by number. Names are
    numbered part by part: those before a suffix first, then by score, then by place; a place is filled from the end of its part."""
    names: list[str] = []
    parts = []
    for part in text.split(SEPARATOR):
        found = _found(part, text, rules)
        names += dict.fromkeys(n for _, _, _, n in found if n not in names)
        for _, _, at, name in sorted(found, key=lambda f: f[2], reverse=True):
            part = f"{part[:at]}<<NAME_{names.index(name)}>>{part[at + len(name) :]}"
        parts.append(part)
    return SEPARATOR.join(parts), names


def guard(text: Column, rules: NameRules = NameRules()) -> Column:  # noqa: B008
    """masked and names of a text; of a null text null and no names."""

    @F.pandas_udf(StructType([StructField("masked", StringType()), StructField("names", ArrayType(StringType()))]))
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, []) if t is None else masked(t, rules) for t in texts], columns=["masked", "names"])

    return run(text)

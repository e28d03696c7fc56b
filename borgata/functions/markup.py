"""Elements of page text, each up to its own end tag.

The text is cut before every tag that matters for an element, and one fold over the pieces counts how deep
they stand: an element ends where its own level is left, however many of its kind it holds.  Everything is
array functions inside the row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from borgata.functions.text import let

# Elements that end where the next of them begins, and the elements inside which that does not hold.
IMPLIED_END = {
    "li": ("li", "ul|ol|menu"), "p": ("p", ""), "option": ("option", "select"), "tr": ("tr", "table"),
    "td": ("td|th|tr", "table"), "th": ("td|th|tr", "table"), "dt": ("dt|dd", "dl"), "dd": ("dt|dd", "dl"),
}


@dataclass(frozen=True)
class Element:
    """A pattern ``…<name…>(.*?)</name>``: what stands before the tag, the tag up to the group, the name."""

    flags: str
    before: str
    tag: str
    name: str

    @classmethod
    def of(cls, pattern: str) -> Element | None:
        parts = re.fullmatch(r"(\(\?[a-z]+\))?(.*)\(\.\*\?\)</([A-Za-z][A-Za-z0-9]*)>", pattern, re.S)
        if not parts:
            return None
        flags, opening, name = parts.groups()
        at = opening.rfind("<")
        before, tag = opening[:max(at, 0)], opening[at:]
        own = at >= 0 and re.match(rf"<{name}(?![A-Za-z0-9])", tag)
        if not own or ".*" in before or re.search(r"(?<!\\)\((?!\?:)", opening):
            return None
        return cls(flags or "", before, tag, name.lower())

    def _names(self) -> str:
        return "|".join(x for x in IMPLIED_END.get(self.name, (self.name,)) if x)

    def parts(self, html: Column) -> Column:
        return F.split(html, F.lit(rf"(?i)(?=</?(?:{self._names()})[\s/>])"))

    def _read(self, parts: Column) -> Column:
        """For each piece: whether an element begins there, how the level changes, and whether an end is implied."""
        own, around = IMPLIED_END.get(self.name, ("", self.name))

        def one(x: Column, i: Column) -> Column:
            opens = F.rlike(x, F.lit(f"{self.flags}^{self.tag}"))
            if self.before:
                opens = opens & F.coalesce(F.rlike(F.get(parts, i - 1), F.lit(f"{self.flags}{self.before}$")), F.lit(False))
            step = F.lit(0)
            if around and not own:
                # Every piece but the first begins with one of the element's own tags.
                leads = (i > 0) | F.rlike(x, F.lit(rf"(?i)^</?{around}[\s/>]"))
                step = F.when(leads, F.when(F.startswith(x, F.lit("</")), -1).otherwise(1)).otherwise(0)
            elif around:
                step = F.when(F.rlike(x, F.lit(rf"(?i)^<(?:{around})[\s/>]")), 1).when(
                    F.rlike(x, F.lit(rf"(?i)^</(?:{around})[\s/>]")), -1).otherwise(0)
            ends = F.rlike(x, F.lit(rf"(?i)^</?(?:{own})[\s/>]")) if own else F.lit(False)
            return F.struct(opens.alias("opens"), step.alias("step"), ends.alias("ends"), i.alias("i"))

        return F.transform(parts, one)

    def flat(self, html: Column, found: Column) -> Column:
        """Whether the pattern's own matches are the elements: every one that opens has ended, and none holds a
        tag that matters.  Most text is so, and needs no fold."""
        tag = F.lit(rf"(?i)</?(?:{self._names()})[\s/>]")
        ended = F.size(found) == F.regexp_count(html, F.lit(self.flags + self.before + self.tag))
        return ended & ~F.exists(found, lambda x: F.rlike(x, tag))

    def spans(self, parts: Column, follow: bool = False) -> Column:
        """(a, b, second) of the outermost elements: the piece that opens each and the piece that ends it.  An
        element that nothing ends goes to the end.  With ``follow``, the element of the same name right after one
        is a span too, its ``second``."""
        none = F.array().cast("array<struct<a:int,b:int,second:boolean>>")
        begin = F.struct(F.lit(0).alias("level"), F.lit(-1).alias("start"), F.lit(False).alias("second"), none.alias("spans"))
        right_after = rf"(?i)^</{self.name}\s*>\s*$"

        def merge(acc: Column, x: Column) -> Column:
            inside = acc["start"] >= 0
            level = acc["level"] + x["step"]
            closes = inside & ((level <= 0) | ((acc["level"] == 1) & x["ends"]))
            second = F.lit(False)
            if follow:
                last = F.get(acc["spans"], F.size(acc["spans"]) - 1)
                second = F.coalesce(~inside & ~last["second"] & (last["b"] == x["i"] - 1) & (x["step"] == 1)
                                    & F.rlike(F.get(parts, x["i"] - 1), F.lit(right_after)), F.lit(False))
            opens = (x["opens"] | second) & (~inside | closes)
            span = F.struct(acc["start"].alias("a"), x["i"].alias("b"), acc["second"].alias("second"))
            return F.struct(
                F.when(opens, 1).when(closes | ~inside, 0).otherwise(level).alias("level"),
                F.when(opens, x["i"]).when(closes, -1).otherwise(acc["start"]).alias("start"),
                F.when(opens, second).otherwise(acc["second"]).alias("second"),
                F.when(closes, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

        def finish(acc: Column) -> Column:
            rest = F.struct(acc["start"].alias("a"), F.size(parts).alias("b"), acc["second"].alias("second"))
            return F.when(acc["start"] >= 0, F.concat(acc["spans"], F.array(rest))).otherwise(acc["spans"])

        return F.aggregate(self._read(parts), begin, merge, finish)

    def inner(self, parts: Column, span: Column, tag: str | None = None) -> Column:
        """What stands between the tag that opens an element and its end."""
        text = F.array_join(F.slice(parts, span["a"] + 1, span["b"] - span["a"]), "")
        return F.regexp_replace(text, F.lit(f"{self.flags}^{self.tag if tag is None else tag}"), F.lit(""))


def elements(html: Column, pattern: str) -> Column:
    """Group 1 of every match.  A group that runs to an end tag is the whole element, elements of its kind
    inside it included; any other pattern is matched as it stands."""
    e = Element.of(pattern)
    if e is None:
        return F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    return let(html, lambda h: let(F.regexp_extract_all(h, F.lit(pattern), F.lit(1)), lambda found: F.when(
        e.flat(h, found), found).otherwise(let(e.parts(h), lambda parts: F.transform(e.spans(parts), lambda s: e.inner(parts, s))))))


def element(html: Column, pattern: str) -> Column:
    """The first of ``elements``, NULL without any; an empty one stays ''."""
    return F.get(elements(html, pattern), F.lit(0))


def element_pairs(html: Column, pattern: str) -> Column:
    """(k, v) of every element that the pattern opens and the element of the same name right after it."""
    e = Element.of(pattern)
    if e is None:
        raise ValueError("the pattern has to be an element's: <name…>(.*?)</name>")

    def both(parts: Column, spans: Column) -> Column:
        def pair(s: Column, j: Column) -> Column:
            title = F.get(spans, j - 1)
            return F.when(s["second"], F.struct(e.inner(parts, title).alias("k"), e.inner(parts, s, rf"<{e.name}[^>]*>").alias("v")))

        return F.array_compact(F.transform(spans, pair))

    return let(e.parts(html), lambda parts: let(e.spans(parts, follow=True), lambda spans: both(parts, spans)))

"""Selections written as text, such as `ws0,f090|f150,-moon,night,yr>2025.5,hits('gal'),::10`.

A selection is a comma-separated list of conditions that all hold. Names in it stand for columns, constants, tags or
conditions; they are replaced, and Spark's own expression parser reads what comes out. Everything is judged once, on the
table it is given: of sub-observations (with a column `band`) or of observations, where conditions on bands select what
can have them and their negations select everything.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.operators import sky
from scanloom.sources import catalog

#: Names of telescopes and optics tubes, of planets among tags, and moments in Unix seconds (fixed values).
TELESCOPES = ("lat", "satp1", "satp2", "satp3", "satp4", "satp5", "satp6")
TUBES = ("c1", "i1", "i2", "i3", "i4", "i5", "i6", "o1", "o2", "o3", "o4", "o5", "o6")
PLANETS = ("mercury", "venus", "mars", "jupiter", "saturn", "uranus", "neptune", "moon", "sun")
MOMENTS = {"tcorot": 1749513600, "tfoc2": 1756684800, "taso": 1770000000, "twire": 1777208400}
BAND_FLAVOR = {b: f for f, bands in catalog.FLAVOR_BANDS.items() for b in bands if b != "DARK"}

#: What the names of values stand for in the tables of sources.catalog.
ALIASES = {"t": "ctime", "timestamp": "ctime", "duration": "dur", "n_samples": "nsamp", "az_center": "baz", "el_center": "bel", "roll_center": "roll", "az_throw": "waz", "el_throw": "wel"}
_YEAR = "((ctime - 1735689600.0D) / 31556926.08D + 2025)"
_SIDE = "(pmod(baz + 180, 360.0D) - 180)"
_HOUR = "(pmod(ctime / 3600, 24.0D) between 11 and 23)"

_SLICE = re.compile(r"[+-]?\d*:[+-]?\d*(?::[+-]?\d*)?")
_TOKEN = re.compile(
    r"\s*(?:(?P<text>'[^']*'|\"[^\"]*\")|(?P<id>obs_\w+(?::\w+)*)|(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(?P<name>[A-Za-z]\w*)"
    r"|(?P<op><=|>=|==|!=|<>|[-+*/%<>=()\[\],&|~]))"
)
_WORDS = frozenset("and or not between in like is null true false case when then else end".split())
_SKY = ("hits", "maxel", "minel")


class SelectionError(ValueError):
    """A selection that cannot be read, or a name that nothing is known of."""


def split_top(text: str) -> list[str]:
    """The parts between commas that stand outside of quotes and brackets, blank ones dropped."""
    parts, depth, quote, at = [""], 0, "", 0
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                raise SelectionError(f"a bracket closes that none opens: {text!r}")
        if c == "," and not depth and not quote:
            parts.append("")
        else:
            parts[-1] += c
    if depth or quote:
        raise SelectionError(f"a bracket or a quote stays open: {text!r}")
    return [p.strip() for p in parts if p.strip()]


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, text) of each token; kinds are text, id, number, name and op."""
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise SelectionError(f"cannot read {text[at:].strip()!r}")
        out.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return out


@dataclass
class Selection:
    """What a text selects: a condition in SQL, and what needs more than the row."""

    condition: str = "true"
    tags: list[str] = field(default_factory=list)
    ids: str | None = None
    slices: list[tuple[int | None, int | None, int]] = field(default_factory=list)
    sky: list[tuple[str, list[str | float]]] = field(default_factory=list)
    good: bool = True
    bad: bool = False


class _Reader:
    def __init__(self, columns: list[str], tags: frozenset[str]):
        self.columns, self.tags, self.sub = frozenset(columns), tags, "band" in columns
        self.out = Selection()
        self.typed = False
        self.told: dict[str, bool] = {}

    def read(self, text: str) -> Selection:
        conditions = []
        for part in split_top(text):
            if part.startswith("@"):
                self.out.ids, self.typed = part[1:], True
            elif _SLICE.fullmatch(part):
                a, b, *c = (int(x) if x else None for x in part.split(":"))
                step = c[0] if c and c[0] is not None else 1
                if step < 1:
                    raise SelectionError(f"a slice goes forward: {part!r}")
                self.out.slices.append((a, b, step))
            else:
                conditions.append(f"({self.expression(part)})")
        if not self.typed and "det_type" in self.columns:
            conditions.append("(det_type = 'OPTC')")
        self.out.good, self.out.bad = self.told.get("good", not self.told), self.told.get("bad", False)
        if self.out.bad and not self.out.good:
            raise SelectionError("a selection of bad observations only is not supported")
        if not self.out.good and not self.out.bad:
            conditions.append("(false)")
        self.out.condition = " and ".join(conditions) or "true"
        return self.out

    def expression(self, text: str) -> str:
        toks = [("name" if tok in self.columns else kind, tok) for kind, tok in tokens(text)]
        sql, k = [], 0
        while k < len(toks):
            kind, tok = toks[k]
            before = toks[k - 1][1].lower() if k else "("
            opens = before in ("(", "[", ",", "&", "|", "~", "and", "or", "not")
            sign = tok if kind == "op" and (tok == "~" or tok in "+-" and opens) else ""
            if sign and k + 1 < len(toks) and toks[k + 1][0] in ("name", "id") and not self.is_value(toks, k + 1):
                k += 1
                sql.append(self.condition(*toks[k], sign))
            elif kind == "text":
                sql.append("'" + tok[1:-1].replace("\\", "\\\\").replace("'", "''") + "'")
            elif kind == "name" and tok.lower() in _WORDS:
                sql.append(tok.lower())
            elif kind == "name" and tok in _SKY and toks[k + 1 : k + 2] == [("op", "(")]:
                k, call = self.sky_call(toks, k)
                sql.append(call)
            elif kind in ("name", "id"):
                sql.append(self.value(tok) if kind == "name" and self.is_value(toks, k) else self.condition(kind, tok))
            elif kind == "op":
                sql.append({"&": "and", "|": "or", "~": "not", "==": "=", "[": "(", "]": ")"}.get(tok, tok))
            else:
                sql.append(tok + ("D" if "." in tok or "e" in tok.lower() else ""))
            k += 1
        return " ".join(sql)

    def is_value(self, toks: list[tuple[str, str]], k: int) -> bool:
        """Whether a name is a value or a function, and not a condition of its own."""
        kind, tok = toks[k]
        if kind != "name":
            return False
        called = toks[k + 1 : k + 2] == [("op", "(")]
        return called or tok in MOMENTS or tok == "yr" or ALIASES.get(tok, tok) in self.columns

    def value(self, name: str) -> str:
        if name in MOMENTS:
            return str(MOMENTS[name])
        return _YEAR if name == "yr" else ALIASES.get(name, name)

    def condition(self, kind: str, name: str, sign: str = "") -> str:
        """A condition's SQL under a sign: + takes any, - and ~ take the others."""
        if kind == "id":
            obs, *rest = name.split(":")
            sql = "(" + " and ".join([f"obs_id = '{obs}'", *(self.condition("name", x) for x in rest)]) + ")"
            return f"(not {sql})" if sign in ("-", "~") else "true" if sign == "+" else sql
        if name in ("good", "bad"):
            other = "bad" if name == "good" else "good"
            self.told |= {"": {name: True, other: False}, "+": {name: True}, "-": {name: False}, "~": {name: False, other: True}}[sign]
            self.told.setdefault("good", True)
            return "true"
        if name.upper() in ("DARK", "OPTC"):
            self.typed = True
        sql = self.named(name)
        if sql is None:
            raise SelectionError(f"{name!r} is neither a known condition nor a tag nor a column")
        if sign == "+":
            return "true"
        if sign in ("-", "~"):
            coarse = not self.sub and (name in BAND_FLAVOR or re.fullmatch(r"ws\d+", name) or name.upper() in ("DARK", "OPTC"))
            return "true" if coarse else f"(not {sql})"
        return sql

    def named(self, name: str) -> str | None:
        if re.fullmatch(r"ws\d+", name):
            return f"(slot = '{name}')" if self.sub else f"(instr(slots, '{name}') > 0)"
        if name in BAND_FLAVOR:
            return f"(band = '{name}')" if self.sub else f"(flavor = '{BAND_FLAVOR[name]}')"
        if name in TELESCOPES:
            return f"(telescope = '{name}')"
        if name in TUBES:
            return f"(tube = '{name}')"
        if name.upper() in ("DARK", "OPTC"):
            return f"(det_type = '{name.upper()}')" if "det_type" in self.columns else "true"
        known = {
            "obs": "(type = 'obs')",
            "cmb": "(type = 'obs' and subtype = 'cmb')",
            "day": _HOUR,
            "night": f"(not {_HOUR})",
            "spin": "(fhwp <> 0)",
            "rising": f"({_SIDE} > 10)",
            "setting": f"({_SIDE} < -10)",
        }
        if name in known:
            return known[name]
        if name in self.tags:
            return self.tagged([name])
        if name == "planet":
            return self.tagged([p for p in PLANETS if p in self.tags])
        return None

    def tagged(self, names: list[str]) -> str:
        self.out.tags += [n for n in names if n not in self.out.tags]
        quoted = ", ".join("'" + n.replace("'", "''") + "'" for n in names)
        return f"(__tags is not null and arrays_overlap(__tags, array({quoted})))" if names else "(false)"

    def sky_call(self, toks: list[tuple[str, str]], k: int) -> tuple[int, str]:
        """hits(...), maxel(...) or minel(...) with constants: where it ends, and the column that stands for it."""
        name, args, sign, end = toks[k][1], [], 1.0, k + 2
        while end < len(toks) and toks[end][1] != ")":
            kind, tok = toks[end]
            if kind == "text":
                args.append(tok[1:-1].lower())
            elif kind == "number":
                args.append(sign * float(tok))
            elif tok not in "+-," or kind != "op":
                raise SelectionError(f"{name}() takes names in quotes and numbers, not {tok!r}")
            sign = -1.0 if tok == "-" else 1.0
            end += 1
        if not args or len(args) > 3 or isinstance(args[0], float) and len(args) < 2 or any(isinstance(a, str) for a in args[1:]):
            raise SelectionError(f"{name}() takes a name, or right ascension and declination")
        self.out.sky.append((name, args))
        return end, f"__sky{len(self.out.sky) - 1}"


def parse(text: str, columns: list[str], tags: frozenset[str] = frozenset()) -> Selection:
    """Reads a selection for a table of these columns; `tags` are those of the text's names that some row has."""
    return _Reader(columns, tags).read(text)


def known_tags(text: str, tags: DataFrame) -> frozenset[str]:
    """Of the names in a selection those that are tags; the driver gets no others."""
    parts = (p for p in split_top(text) if not p.startswith("@") and not _SLICE.fullmatch(p))
    names = {t for p in parts for kind, t in tokens(p) if kind == "name"}
    names |= set(PLANETS) if "planet" in names else set()
    return frozenset(r["tag"] for r in tags.where(F.col("tag").isin(sorted(names))).select("tag").distinct().collect())


def select(rows: DataFrame, text: str, tags: DataFrame | None = None, pre_map: DataFrame | None = None, tracks: DataFrame | None = None, key: str = "obs_key") -> DataFrame:
    """The rows that a selection takes, with their columns; with an id list, `pos` is their place in it.

    rows: observations or sub-observations. tags: (key, tag). pre_map: (key) and, if given, slot and band, of what has
    preprocessing results; without it good and bad select everything. tracks: (name, t, ra, dec) of moving objects, for
    hits('name') and maxel('name'). Slices take rows in the order of the id list, or else of the ids. Nothing selected
    gives no rows; a null value makes its condition fail, whatever its sign.
    """
    got = parse(text, rows.columns, known_tags(text, tags) if tags is not None else frozenset())
    own, out = rows.columns, rows
    if got.tags:
        lists = tags.where(F.col("tag").isin(got.tags)).groupBy(key).agg(F.collect_set("tag").alias("__tags"))
        out = out.join(lists, key, "left")
    for n, (name, args) in enumerate(got.sky):
        out = _with_sky(out, name, args, f"__sky{n}", tracks)
    out = out.where(got.condition)
    if pre_map is not None and got.good and not got.bad:
        on = [key, *(c for c in ("slot", "band") if c in pre_map.columns and c in rows.columns)]
        out = out.join(pre_map.select(*on), on, "left_semi")
    out, order = out.select(*own), ["subobs_id"] if "subobs_id" in own else ["obs_id"]
    if got.ids is not None:
        ids = catalog.read_id_list(rows.sparkSession, got.ids)
        if "subobs_id" in own and ":" in (ids.orderBy("pos").first() or [""])[0]:
            out = out.join(ids.withColumnRenamed("id", "subobs_id"), "subobs_id")
        else:
            whole = ids.groupBy(F.substring_index("id", ":", 1).alias("obs_id")).agg(F.min("pos").alias("pos"))
            out = out.join(whole, "obs_id")
        order, own = ["pos", *order], [*own, "pos"]
    for start, stop, step in got.slices:
        # the place among what is left, by the order of the ids or of the list
        out = catalog.positional_slice(out.withColumnRenamed("pos", "__pos") if "pos" in own else out, ["__pos" if c == "pos" else c for c in order], start, stop, step)
        out = out.drop("pos").withColumnRenamed("__pos", "pos") if "pos" in own else out.drop("pos")
    return out.select(*own)


def _with_sky(rows: DataFrame, name: str, args: list[str | float], column: str, tracks: DataFrame | None) -> DataFrame:
    """rows with the result of hits() (boolean), or the elevation of maxel() and minel() (rad). Needs sky.with_sweep()."""
    ras, decs, dur, radius = F.col("ras"), F.col("decs"), F.col("dur"), F.col("radius")
    if name == "hits" and args[0] == "gal":
        least = math.radians(args[1] if len(args) > 1 else 5)
        return rows.withColumn(column, sky.galaxy_hit(ras, decs, dur, radius, least, math.radians(args[2] if len(args) > 2 else 1)))

    def judged(ra: Column, dec: Column) -> Column:
        if name == "hits":
            pad = args[2] if len(args) > 2 else args[1] if isinstance(args[0], str) and len(args) > 1 else 1.0
            return sky.point_hit(ra, dec, ras, decs, dur, radius, math.radians(pad))
        both = [sky.elevation(ra, dec, F.col("ctime") + after) for after in (F.lit(0.0), dur)]
        return F.greatest(*both) if name == "maxel" else F.least(*both)

    if not isinstance(args[0], str):
        return rows.withColumn(column, judged(F.lit(math.radians(args[0])), F.lit(math.radians(args[1]))))
    if tracks is None:
        raise SelectionError(f"{name}({args[0]!r}) needs tracks of moving objects")
    names = None if args[0] == "planet" else args[0].split(",")
    at = sky.positions_at(rows.select("obs_key", "ctime").distinct(), tracks if names is None else tracks.where(F.col("name").isin(names)), "obs_key", "ctime")
    lists = at.groupBy("obs_key").agg(F.collect_list(F.struct("ra", "dec")).alias("__at"))
    found = rows.join(lists, "obs_key", "left")
    each = F.transform("__at", lambda p: judged(p["ra"], p["dec"]))
    over = {"hits": F.coalesce(F.exists(each, lambda h: h), F.lit(False)), "maxel": F.array_max(each), "minel": F.array_min(each)}[name]
    return found.withColumn(column, over).drop("__at")

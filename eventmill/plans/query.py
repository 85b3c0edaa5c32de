"""A query as a value: its predicates become one filter, its order one sort; it reads and writes the text of a link."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import derive, filters, orders

FLAGS = ("free", "eligible", "saved", "online", "weekend", "all-status")


@dataclass(frozen=True)
class QuerySpec:
    q: str = ""
    age: int = 14
    sort: str = "date"
    view: str = "cards"
    when: str = "90"
    shape: str = "all"
    since: str = ""
    until: str = ""
    cities: frozenset[str] = field(default_factory=frozenset)
    careers: frozenset[str] = field(default_factory=frozenset)
    styles: frozenset[str] = field(default_factory=frozenset)
    flags: frozenset[str] = field(default_factory=frozenset)

    def to_params(self) -> str:
        """What differs from the defaults, sets joined by a pipe."""
        out = {}
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, frozenset):
                v = "|".join(sorted(v))
            default = QuerySpec.__dataclass_fields__[f.name].default if f.name in ("q", "age", "sort", "view", "when", "shape", "since", "until") else ""
            if v != default:
                out[f.name] = v
        return urlencode(out)

    @staticmethod
    def from_params(text: str) -> QuerySpec:
        """Unknown names and an age that isn't a number are ignored."""
        got = {}
        for k, v in parse_qsl(text.lstrip("#?")):
            if k in ("cities", "careers", "styles", "flags"):
                got[k] = frozenset(x for x in v.split("|") if x)
            elif k == "age":
                got |= {"age": int(v)} if v.isdigit() else {}
            elif k in QuerySpec.__dataclass_fields__:
                got[k] = v
        return QuerySpec(**got)


def predicate(events: DataFrame, spec: QuerySpec, now: str) -> Column:
    """All of a query's conditions on a row, cheap ones first. now: an ISO text of London time."""
    has = set(events.columns)
    start, end, run, anytime = F.col("start_ts"), F.col("end_ts"), F.col("ongoing"), F.col("anytime")
    p = F.lit(True) if "all-status" in spec.flags else F.coalesce(F.col("status"), F.lit("scheduled")) == "scheduled"
    p = p & filters.in_window(start, end, *filters.window_bounds(spec.when, now, spec.since, spec.until))
    if spec.shape != "all":
        p = p & filters.kind_is(spec.shape, run, anytime)
    p = p & filters.in_city(F.col("online"), F.col("city"), sorted(spec.cities))
    for column, wanted in (("careers", spec.careers), ("work_styles", spec.styles)):
        if wanted:
            p = p & filters.any_of(F.col(column), sorted(wanted))
    p = p & filters.age_allows(F.col("age_min"), F.col("age_max"), F.col("audiences"), spec.age, "eligible" in spec.flags)
    if "free" in spec.flags:
        p = p & filters.is_free(F.col("is_free"))
    if "online" in spec.flags:
        p = p & F.col("online")
    if "weekend" in spec.flags:
        p = p & filters.on_weekend(start, F.coalesce(F.col("exhibition"), F.lit(False)) if "exhibition" in has else F.lit(False))
    if spec.q.strip():
        p = p & filters.has_all_terms(derive.haystack(events), spec.q)
    return p


def apply(events: DataFrame, spec: QuerySpec, now: str, saved: DataFrame | None = None, hidden: DataFrame | None = None) -> DataFrame:
    """The rows a query shows, unsorted. saved and hidden: tables of ids."""
    out = events.filter(predicate(events, spec, now))
    if hidden is not None:
        out = filters.without_hidden(out, hidden, "saved" in spec.flags)
    if saved is not None and "saved" in spec.flags:
        out = filters.only_saved(out, saved)
    return out


def run(events: DataFrame, spec: QuerySpec, now: str, **users: DataFrame) -> DataFrame:
    return apply(events, spec, now, **users).orderBy(*orders.order(spec.sort))

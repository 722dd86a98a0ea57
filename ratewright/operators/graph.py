"""A typed object graph over frames: objects, links, sets that stay lazy, and actions that write back to a log."""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = {"string": "string", "integer": "bigint", "double": "double", "boolean": "boolean", "timestamp": "string"}


class SpecError(ValueError):
    """All that is wrong with a specification."""

    def __init__(self, errors: list[str]):
        super().__init__("; ".join(errors))
        self.errors = errors


class ObjectError(ValueError):
    """Rows that don't fit their type."""


class ActionRejected(ValueError):
    """Why an action was refused; nothing was written."""

    def __init__(self, reasons: list[str]):
        super().__init__("; ".join(reasons))
        self.reasons = reasons


@dataclass(frozen=True)
class Property:
    type: str
    nullable: bool = True
    editable: bool = False
    default: object = None


@dataclass(frozen=True)
class ObjectType:
    name: str
    key: str
    properties: dict[str, Property]


@dataclass(frozen=True)
class Link:
    """many-to-one by a foreign key of `source`, or many-to-many by the source's boolean columns that are named by target keys."""

    name: str
    source: str
    target: str
    foreign_key: str | None = None
    reverse: str | None = None


@dataclass(frozen=True)
class Parameter:
    type: str
    required: bool = False
    required_when: tuple[str, object] | None = None
    allowed: tuple[object, ...] | None = None
    longest: int | None = None


@dataclass(frozen=True)
class Action:
    """edits: property to a parameter's name ("$name") or a value; criteria: property to the value it must have before."""

    name: str
    target: str
    parameters: dict[str, Parameter]
    edits: dict[str, object]
    criteria: dict[str, object] = field(default_factory=dict)


@dataclass(frozen=True)
class Spec:
    objects: dict[str, ObjectType]
    links: dict[str, Link]
    actions: dict[str, Action]

    def validate(self, functions: tuple[str, ...] = (), known: tuple[str, ...] = ()) -> Spec:
        """Itself, or a SpecError with everything that is wrong."""
        wrong = []
        for o in self.objects.values():
            if o.key not in o.properties:
                wrong.append(f"{o.name}: key {o.key} is no property")
            elif o.properties[o.key].nullable or o.properties[o.key].editable:
                wrong.append(f"{o.name}: its key must be neither nullable nor editable")
            wrong += [f"{o.name}.{p}: unknown type {d.type}" for p, d in o.properties.items() if d.type not in TYPES]
        names = [(x.source, x.name) for x in self.links.values()] + [(x.target, x.reverse) for x in self.links.values() if x.reverse]
        wrong += [f"{t}: link {n} is defined twice" for t, n in sorted({x for x in names if names.count(x) > 1})]
        for x in self.links.values():
            wrong += [f"{x.name}: no object type {t}" for t in (x.source, x.target) if t not in self.objects]
            if x.foreign_key and x.source in self.objects and x.target in self.objects:
                own, other = self.objects[x.source].properties.get(x.foreign_key), self.objects[x.target]
                if own is None:
                    wrong.append(f"{x.name}: {x.source} has no {x.foreign_key}")
                elif other.key in other.properties and own.type != other.properties[other.key].type:
                    wrong.append(f"{x.name}: {x.foreign_key} isn't of the type of {x.target}'s key")
        for a in self.actions.values():
            target = self.objects.get(a.target)
            if target is None:
                wrong.append(f"{a.name}: no object type {a.target}")
                continue
            for p, v in a.edits.items():
                if p not in target.properties or not target.properties[p].editable:
                    wrong.append(f"{a.name}: {a.target}.{p} can't be edited")
                if isinstance(v, str) and v.startswith("$") and v[1:] not in a.parameters:
                    wrong.append(f"{a.name}: no parameter {v[1:]}")
            wrong += [f"{a.name}: no property {p}" for p in a.criteria if p not in target.properties]
            wrong += [f"{a.name}.{p}: unknown type {d.type}" for p, d in a.parameters.items() if d.type not in TYPES]
        wrong += [f"no such function: {f}" for f in functions if f not in known]
        if wrong:
            raise SpecError(wrong)
        return self


LOG = "action_id string, action string, actor string, at string, target string, key string, edits array<struct<property:string,before:string,after:string>>, seq long"


class Store:
    """Frames by object type, and the log of actions. Objects are their base rows under the latest edit of each property."""

    def __init__(self, spark: SparkSession, spec: Spec, clock: Callable[[], str] | None = None):
        self.spark, self.spec = spark, spec.validate()
        self.base: dict[str, DataFrame] = {}
        self.entries: list[tuple] = []
        self.clock = clock or (lambda: datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds"))

    @property
    def count(self) -> int:
        return len(self.entries)

    @property
    def log(self) -> DataFrame:
        """One row for each action; its plan doesn't grow with their number."""
        return self.spark.createDataFrame(self.entries, LOG)

    def add(self, kind: str, df: DataFrame, check: bool = True) -> Store:
        """Objects of a type: columns cast to their types, defaults for missing ones; nulls and repeated keys are refused."""
        o = self.spec.objects[kind]
        columns = [(F.col(p).cast(TYPES[d.type]) if p in df.columns else F.lit(d.default).cast(TYPES[d.type])).alias(p) for p, d in o.properties.items()]
        columns = [F.coalesce(c, F.lit(d.default).cast(TYPES[d.type])).alias(p) if d.default is not None else c for c, (p, d) in zip(columns, o.properties.items(), strict=True)]
        out = df.select(*columns)
        if check:
            needed = [p for p, d in o.properties.items() if not d.nullable]
            found = out.agg(F.count("*").alias("__n"), F.count_distinct(o.key).alias("__keys"), *(F.count_if(F.col(p).isNull()).alias(p) for p in needed)).first()
            wrong = [f"{kind}.{p}: {found[p]} nulls" for p in needed if found[p]]
            if found["__keys"] != found["__n"] - (found[o.key] if o.key in needed else 0):
                wrong.append(f"{kind}: repeated keys")
            if wrong:
                raise ObjectError("; ".join(wrong))
        self.base[kind] = out
        return self

    def current(self, kind: str) -> DataFrame:
        """The objects with all edits applied: the latest of each property, found in the log before it is joined."""
        o, df = self.spec.objects[kind], self.base[kind]
        editable = [p for p, d in o.properties.items() if d.editable]
        if not self.count or not editable:
            return df
        flat = self.log.filter(F.col("target") == kind).select("key", "seq", F.explode("edits").alias("e"))
        last = flat.groupBy(F.col("key").alias("__key")).agg(*(F.max_by(F.when(F.col("e.property") == p, F.struct(F.col("e.after").alias("v"))), F.when(F.col("e.property") == p, F.col("seq"))).alias(f"__{p}") for p in editable))
        joined = df.join(last, F.col(o.key).cast("string") == F.col("__key"), "left")
        return joined.select(*((F.when(F.col(f"__{p}").isNotNull(), F.col(f"__{p}.v").cast(TYPES[d.type])).otherwise(F.col(p)).alias(p) if d.editable else F.col(p)) for p, d in o.properties.items()))

    def objects(self, kind: str) -> ObjectSet:
        if kind not in self.spec.objects:
            raise KeyError(kind)
        return ObjectSet(self, kind, self.current(kind))

    def get(self, kind: str, key: object) -> dict | None:
        row = self.current(kind).filter(F.col(self.spec.objects[kind].key) == key).first()
        return row.asDict() if row else None

    def link_rows(self, name: str) -> DataFrame:
        """(source_key, target_key) of a link, without null ends."""
        x = self.spec.links[name]
        source, df = self.spec.objects[x.source], self.current(x.source)
        if x.foreign_key:
            return df.select(F.col(source.key).alias("source_key"), F.col(x.foreign_key).alias("target_key")).filter("target_key is not null")
        flags = [p for p, d in source.properties.items() if d.type == "boolean"]
        pairs = F.explode(F.array_compact(F.array(*(F.when(F.col(p), F.lit(p)) for p in flags))))
        target = self.current(x.target).select(F.col(self.spec.objects[x.target].key).alias("target_key"))
        return df.select(F.col(source.key).alias("source_key"), pairs.alias("target_key")).join(target, "target_key", "left_semi").select("source_key", "target_key")

    def link_integrity(self) -> DataFrame:
        """link, resolved, null_keys, dangling of every foreign key."""
        rows = []
        for x in self.spec.links.values():
            if x.foreign_key:
                own = self.current(x.source).select(F.col(x.foreign_key).alias("k"))
                other = self.current(x.target).select(F.col(self.spec.objects[x.target].key).alias("t"))
                rows.append(own.groupBy("k").count().join(other, F.col("k") == F.col("t"), "left").agg(F.coalesce(F.sum(F.when(F.col("t").isNotNull(), F.col("count"))), F.lit(0)).alias("resolved"), F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("count"))), F.lit(0)).alias("null_keys"), F.coalesce(F.sum(F.when(F.col("k").isNotNull() & F.col("t").isNull(), F.col("count"))), F.lit(0)).alias("dangling")).select(F.lit(x.name).alias("link"), "resolved", "null_keys", "dangling"))
        return reduce(lambda a, b: a.unionByName(b), rows)

    def apply(self, action: str, key: object, params: dict[str, object], actor: str) -> str:
        """Checks everything first, then appends one entry with the edits; refused actions leave no trace. Returns the entry's id."""
        a = self.spec.actions.get(action)
        if a is None:
            raise ActionRejected([f"no action {action}"])
        reasons = [f"no parameter {p}" for p in params if p not in a.parameters]
        for p, d in a.parameters.items():
            v = params.get(p)
            needed = d.required or (d.required_when is not None and params.get(d.required_when[0]) == d.required_when[1])
            if v is None or v == "":
                reasons += [f"{p} is required"] if needed else []
                continue
            kinds = {"string": str, "timestamp": str, "integer": int, "double": (int, float), "boolean": bool}
            if not isinstance(v, kinds[d.type]) or (isinstance(v, bool) and d.type != "boolean"):
                reasons.append(f"{p} must be of type {d.type}")
            elif d.allowed and v not in d.allowed:
                reasons.append(f"{p} must be one of {list(d.allowed)}")
            elif d.longest and len(str(v)) > d.longest:
                reasons.append(f"{p} is longer than {d.longest}")
        if not actor:
            reasons.append("an actor is required")
        now = self.get(a.target, key)
        if now is None:
            reasons.append(f"no {a.target} {key}")
        else:
            reasons += [f"{p} must be {v}" for p, v in a.criteria.items() if now[p] != v]
        if reasons:
            raise ActionRejected(reasons)
        text = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
        value = lambda v: params.get(v[1:]) if isinstance(v, str) and v.startswith("$") else v
        name = f"act-{self.count + 1:06d}"
        entry = (name, action, actor, self.clock(), a.target, str(key), [(p, text(now[p]), text(value(v))) for p, v in a.edits.items()], self.count + 1)
        self.entries.append(entry)
        return name

    def edit_history(self, kind: str, key: object) -> DataFrame:
        return self.log.filter((F.col("target") == kind) & (F.col("key") == str(key))).select("action_id", "action", "actor", "at", F.explode("edits").alias("e"), "seq").select("action_id", "action", "actor", "at", "e.*", "seq").orderBy("seq")

    def save(self, database: str) -> None:
        """A table for each type, link and the log, in a database of the session's catalogue."""
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
        for kind in self.base:
            self.current(kind).write.mode("overwrite").saveAsTable(f"{database}.{kind}")
        for x in self.spec.links.values():
            self.link_rows(x.name).write.mode("overwrite").saveAsTable(f"{database}.link_{x.name}")
        self.log.write.mode("overwrite").saveAsTable(f"{database}.action_log")
        self.described().write.mode("overwrite").saveAsTable(f"{database}.spec")

    def described(self) -> DataFrame:
        """element (type, link or action), name and its definition as JSON: a saved store tells what it holds."""
        parts = {"type": self.spec.objects, "link": self.spec.links, "action": self.spec.actions}
        rows = [(e, k, json.dumps(asdict(v), sort_keys=True, default=str)) for e, held in parts.items() for k, v in sorted(held.items())]
        return self.spark.createDataFrame(rows, "element string, name string, definition string")

    def tables(self) -> dict[str, DataFrame]:
        """Everything that a saved store holds, by name."""
        out = {kind: self.current(kind) for kind in self.base} | {f"link_{x.name}": self.link_rows(x.name) for x in self.spec.links.values()}
        return out | {"action_log": self.log, "spec": self.described()}

    def save_json(self, folder: str) -> None:
        """A folder of JSON lines for each table of the store, written by the executors; nulls are kept as such."""
        for name, df in self.tables().items():
            df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/{name}")

    def call(self, function: str, *args: object, **named: object) -> object:
        """One of the store's functions, by name; unknown names are an error. They get the store first."""
        if function not in FUNCTIONS:
            raise KeyError(function)
        return FUNCTIONS[function](self, *args, **named)


@dataclass(frozen=True)
class ObjectSet:
    """Objects of one type, as a plan: nothing runs until it is asked for rows."""

    store: Store
    kind: str
    frame: DataFrame

    @property
    def key(self) -> str:
        return self.store.spec.objects[self.kind].key

    def where(self, **equal: object) -> ObjectSet:
        if unknown := [p for p in equal if p not in self.frame.columns]:
            raise KeyError(f"unknown properties: {unknown}")
        return replace(self, frame=reduce(lambda d, kv: d.filter(F.col(kv[0]).eqNullSafe(F.lit(kv[1]))), equal.items(), self.frame))

    def filter(self, condition: Column) -> ObjectSet:
        return replace(self, frame=self.frame.filter(condition))

    def search_around(self, link: str) -> ObjectSet:
        """What the set's objects are linked with, each object once; links may be followed from either end."""
        spec = self.store.spec
        x = next((x for x in spec.links.values() if (x.name == link and x.source == self.kind) or (x.reverse == link and x.target == self.kind)), None)
        if x is None:
            raise KeyError(f"{self.kind} has no link {link}")
        forward = x.name == link and x.source == self.kind
        near, far, other = ("source_key", "target_key", x.target) if forward else ("target_key", "source_key", x.source)
        reached = self.store.link_rows(x.name).join(self.frame.select(F.col(self.key).alias("__k")), F.col(near) == F.col("__k"), "left_semi").select(F.col(far).alias("__far"))
        target = self.store.objects(other)
        return replace(target, frame=target.frame.join(reached, F.col(target.key) == F.col("__far"), "left_semi"))

    def count(self) -> int:
        return self.frame.count()

    def keys(self) -> DataFrame:
        return self.frame.select(self.key)

    def one(self) -> dict:
        rows = self.frame.limit(2).collect()
        if len(rows) != 1:
            raise LookupError("not exactly one object")
        return rows[0].asDict()

    def to_frame(self) -> DataFrame:
        return self.frame


def included(filings: DataFrame) -> DataFrame:
    """Filings that count in benchmarks: passing the screen, and neither flagged by an analyst nor set aside."""
    return filings.filter(~F.col("implausible") & ~F.col("analyst_flag") & ~F.col("benchmark_excluded"))


def latest_by(df: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """The last row of each key; combined where rows are read."""
    last = df.groupBy(key).agg(F.max_by(F.struct(*(c for c in df.columns if c != key)), F.struct(time, tie)).alias("last"))
    return last.select(*(c if c == key else F.col("last")[c].alias(c) for c in df.columns))


def filing_of(store: Store, filing_id: object) -> dict:
    found = store.get("Filing", filing_id)
    if found is None:
        raise LookupError(f"no Filing {filing_id}")
    return found


def screen_of(store: Store, filing_id: object) -> dict:
    """The verdict on one filing, and the flags that it rests on."""
    row = filing_of(store, filing_id)
    return {"implausible": row["implausible"], "flags": sorted(k for k, v in row.items() if k.startswith("flag_") and v is True)}


def rate_of(store: Store, filing_id: object) -> float | None:
    """Cases for 200,000 hours of one filing; None without hours."""
    row = filing_of(store, filing_id)
    return 200_000 * row["cases"] / row["hours"] if row["hours"] and row["hours"] > 0 and row["cases"] is not None else None


def pooled_rate_of(store: Store, filings: ObjectSet | None = None) -> float | None:
    """The ratio of sums over a set's filings that count, or over all of them."""
    rows = included((filings or store.objects("Filing")).frame)
    c, h = rows.agg(F.sum("cases"), F.sum("hours")).first()
    return 200_000 * c / h if h else None


def peers_of(store: Store, filing_id: object) -> ObjectSet:
    """The filings of the same group and year that count, the filing itself among them."""
    row = filing_of(store, filing_id)
    every = store.objects("Filing").where(peer_group=row["peer_group"], year=row["year"])
    return replace(every, frame=included(every.frame))


def position_of(store: Store, filing_id: object) -> dict:
    """How many of a filing's peers have a lower rate, the same one, or a higher one; None without peers or rate."""
    own, frame = rate_of(store, filing_id), peers_of(store, filing_id).frame
    rate = 200_000 * F.col("cases") / F.when(F.col("hours") > 0, F.col("hours"))
    if own is None:
        return {"n": frame.count(), "below": None, "equal": None, "above": None}
    n, below, equal, above = frame.agg(F.count("*"), F.count_if(rate < own), F.count_if(rate == own), F.count_if(rate > own)).first()
    return {"n": n, "below": below, "equal": equal, "above": above}


#: What `Store.call` knows.
FUNCTIONS: dict[str, Callable] = {"plausibility_screen": screen_of, "filing_rate": rate_of, "aggregate_rate": pooled_rate_of, "peer_filings": peers_of, "peer_position": position_of}


def schema_of(o: ObjectType) -> T.StructType:
    return T.StructType([T.StructField(p, T._parse_datatype_string(TYPES[d.type]), d.nullable) for p, d in o.properties.items()])

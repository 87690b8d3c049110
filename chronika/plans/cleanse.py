"""The cleansing pipeline: ordered, idempotent passes over a catalogue."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronika.functions import text
from chronika.operators import joins, reconcile, resolve, sourcing
from chronika.operators.filters import protected
from chronika.sources.catalog import Catalog
from chronika.sources.staging import Steps, written

Pass = Callable[[Catalog], Catalog]


@dataclass(frozen=True)
class Inputs:
    """Tables and patterns that the passes are given. wars: name, start, end; aliases: alias, name; canonical: title, canonical."""

    wars: DataFrame
    aliases: DataFrame
    canonical: DataFrame
    overrides: DataFrame
    allowed: DataFrame
    banned: str = r"massacre|treaty|protest|election"
    military: str = r"battle|siege|war|campaign|raid|combat|skirmish|naval|military|invasion|offensive"
    families: tuple = ()  # (pattern of a war's name, its boxes)
    extra: dict = field(default_factory=dict)


def on_events(fn: Callable[[DataFrame], DataFrame]) -> Pass:
    return lambda c: c.with_(events=fn(c.events))


@dataclass(frozen=True)
class RowPass:
    """A pass over one table that judges each row by its columns `reads`, and by tables that no pass changes.

    It keeps the rows where `keep` holds, or changes the columns `writes`: `change` returns the rows that it is given, none
    more and none less. Rows that are equal in what is read and written fare alike, whatever else stands in the table.
    """

    table: str
    reads: tuple[str, ...]
    writes: tuple[str, ...] = ()
    change: Callable[[DataFrame], DataFrame] | None = None
    keep: Column | None = None

    def __call__(self, catalog: Catalog) -> Catalog:
        rows = getattr(catalog, self.table)
        return catalog.with_(**{self.table: rows.filter(self.keep) if self.change is None else self.change(rows)})


def clean_event_text(events: DataFrame) -> DataFrame:
    """Fields of unprotected rows without markup; protected rows stay as they are."""
    free = ~protected(F.col("source"), F.col("verified"))
    cleaned = {"name": text.strip_markup(F.col("name")), "war": text.null_junk(text.strip_markup(F.col("war"))), "victor": text.clean_wikitext(F.col("victor")), "summary": text.clean_prose(F.col("summary")), "significance": text.clean_prose(F.col("significance"))}
    return events.withColumns({k: F.when(free, v).otherwise(F.col(k)) for k, v in cleaned.items()})


def clean_side_text(sides: DataFrame) -> DataFrame:
    return sides.withColumns({"name": text.clean_side_name(F.col("name")), **{k: text.clean_wikitext(F.col(k)) for k in ("commander", "strength", "casualties")}})


def passes(given: Inputs) -> list[tuple[str, Pass]]:
    """Names and passes in their order, which matters: wars are filled before dates are judged by their spans, and merged last."""
    spans = given.wars.select("name", "start", "end")
    return [
        ("clear unsourced wars", on_events(lambda e: resolve.clear_unsourced_wars(e, given.wars))),
        ("fill wars", on_events(lambda e: sourcing.fill_wars_within(e, spans, given.families))),
        ("event text", on_events(clean_event_text)),
        ("side text", lambda c: c.with_(sides=clean_side_text(c.sides))),
        ("missing date", on_events(resolve.fill_missing_date)),
        ("canonical date", on_events(resolve.canonical_dates)),
        ("source dates", on_events(lambda e: reconcile.reconciled(e, given.families))),
        ("war spans", on_events(lambda e: resolve.reconcile_spans(e, spans))),
        ("unsourced years", on_events(resolve.zero_unsourced_years)),
        ("align year", on_events(resolve.align_year)),
        ("era", on_events(resolve.recompute_era)),
        ("era by war", on_events(sourcing.era_by_war)),
        ("blank sides", lambda c: c.with_(sides=resolve.drop_blank_sides(c.sides))),
        ("war names", on_events(lambda e: resolve.spell_wars(e, given.wars))),
        ("war aliases", on_events(lambda e: joins.rename_aliases(e, given.aliases, "war", resolve.free(e)))),
        ("non-battles", lambda c: resolve.drop_non_battles(c, given.banned, given.military)),
        ("twins", lambda c: resolve.merge(c, resolve.twins_to_merge(joins.twins(c.events, given.canonical), given.allowed.join(c.events.select(F.col("id").alias("drop")), "drop", "left_semi")), "twin")),
        ("shared titles", lambda c: resolve.merge(c, resolve.shared_title_survivors(c), "shared title")),
        ("overrides", on_events(lambda e: resolve.override_points(e, given.overrides))),
    ]


#: Passes after which the tables are written and reread, so that no plan holds all of them.
WRITE_AFTER = ("side text", "source dates", "era by war", "war aliases", "non-battles", "twins", "shared titles", "overrides")


def kept(catalog: Catalog) -> Catalog:
    """The tables, written to the shared checkpoint folder."""
    return catalog.with_(**{t: written(getattr(catalog, t)) for t in Catalog.TABLES})


def cleanse(catalog: Catalog, given: Inputs, settle: Callable[[Catalog], Catalog] | None = None) -> Catalog:
    """All passes once, in order. The tables are written between groups of them; with settle, by this function after each pass."""
    for name, step in passes(given):
        catalog = step(catalog)
        if settle is not None:
            catalog = settle(catalog)
        elif name in WRITE_AFTER:
            catalog = kept(catalog)
    return catalog


#: What a pass may change of an event; each change of one is an entry of the log.
TRACED = ("name", "date", "year", "date_start", "date_end", "lat", "lng", "era", "war", "battle_type", "victor", "summary", "significance")
ENTRY = "struct<pass:string,column:string,was:string,now:string>"
ROUND_ENTRY = "struct<round:int,pass:string,column:string,was:string,now:string>"
CHANGE = "pass string, table string, id string, column string, was string, now string"


def traced(name: str, step: Pass) -> Pass:
    """The pass, which also notes for each event that stays what it changed of it, in the column _log that rides along."""

    def run(catalog: Catalog) -> Catalog:
        after = step(catalog.with_(events=catalog.events.withColumn("_was", F.struct(*TRACED))))
        each = F.array(*(F.struct(F.lit(name).alias("pass"), F.lit(c).alias("column"), F.col(f"_was.{c}").cast("string").alias("was"), F.col(c).cast("string").alias("now")) for c in TRACED))
        return after.with_(events=after.events.withColumn("_log", F.concat("_log", F.filter(each, lambda x: ~x["was"].eqNullSafe(x["now"])))).drop("_was"))

    return run


@dataclass(frozen=True)
class Settled:
    """A catalogue that the passes leave as it is; what they changed before, by round; the number of rounds, the last one without a change.

    changes: round, pass, table, id, column, was, now. Rows that come or go have no column; of sides, references, aliases and
    removed ids the pass is not told.
    """

    catalog: Catalog
    changes: DataFrame
    rounds: int


class Unsettled(RuntimeError):
    """The passes go on changing rows."""


def row_changes(before: DataFrame, after: DataFrame, table: str, key: list[str]) -> DataFrame:
    """(table, id, now) of rows of a table that came, went or changed; rows may repeat."""
    mark = lambda df, sign: df.groupBy(F.concat_ws("/", *key).alias("id"), F.xxhash64(*df.columns).alias("_h")).agg((F.count("*") * sign).alias("_n"))
    both = mark(before, -1).unionByName(mark(after, 1)).groupBy("id", "_h").agg(F.sum("_n").alias("_n")).filter("_n != 0")
    kind = F.when(F.min("_n") > 0, "added").when(F.max("_n") < 0, "removed").otherwise("changed")
    return both.groupBy("id").agg(kind.alias("now")).select(F.lit(table).alias("table"), "id", "now")


KEYS = {"sides": ["battle_id", "side_index"], "references": ["battle_id", "ref_type", "title"], "aliases": ["battle_id", "alias_index"], "removed": ["qid"]}


def fingerprint(rows: DataFrame) -> tuple:
    """The number of rows, and two sums of hashes of them, whatever their order: equal for equal tables."""
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *rows.columns).cast("decimal(20,0)"))
    return tuple(rows.agg(F.count("*"), total(1), total(2)).first())


def settled(catalog: Catalog, steps: list[tuple[str, Pass]], most: int = 20) -> Settled:
    """The passes, in order, again and again until a round changes no row of any table; over `most` rounds raise Unsettled.

    Tables that a pass has changed are written before the next one, and only counts and sums of hashes come to the driver.
    A table that comes out as it went in is dropped for the one before; of those that changed the files of earlier
    rounds go, so the disk holds each table about twice, whatever the number of rounds.

    Where all passes are RowPasses that change events or keep rows of a table, the tables are not written: see settled_values.
    """
    if by_values(steps):
        return settled_rows(catalog, steps, most)
    spark = catalog.events.sparkSession
    files = Steps(spark)
    columns = catalog.events.columns
    children = [t for t in Catalog.TABLES if t != "events"]
    plain = lambda events: events.select(*columns)
    catalog = catalog.with_(**{t: files.saved(getattr(catalog, t)) for t in children}, events=files.saved(catalog.events.withColumn("_log", F.expr(f"cast(array() as array<{ENTRY}>)"))))
    marks = {t: fingerprint(plain(catalog.events) if t == "events" else getattr(catalog, t)) for t in Catalog.TABLES}
    log = None
    for number in range(1, most + 1):
        now, ids = catalog, []
        for name, step in steps:
            after, old = traced(name, step)(now), []
            for t in Catalog.TABLES:
                if getattr(after, t) is getattr(now, t):
                    continue
                out = files.saved(getattr(after, t))
                mark = fingerprint(plain(out) if t == "events" else out)
                if mark == marks[t]:
                    files.drop(out)
                    after = after.with_(**{t: getattr(now, t)})
                    continue
                if getattr(now, t) is not getattr(catalog, t):
                    old.append(getattr(now, t))
                marks[t] = mark
                after = after.with_(**{t: out})
            now = after
            files.drop(*old)  # once all tables of the pass are written, as they may be made of each other
        if now.events is not catalog.events:
            ids.append(row_changes(catalog.events.select("id"), now.events.select("id"), "events", ["id"]))
        ids += [row_changes(getattr(catalog, t), getattr(now, t), t, KEYS[t]) for t in children if getattr(now, t) is not getattr(catalog, t)]
        cells = now.events.select("id", F.explode("_log").alias("e")).select("e.pass", F.lit("events").alias("table"), "id", "e.column", "e.was", "e.now")
        text_ = lambda v=None: F.lit(v).cast("string")
        for found in ids:
            cells = cells.unionByName(found.select(text_().alias("pass"), "table", "id", text_().alias("column"), text_().alias("was"), "now"))
        round_ = files.saved(cells.select(F.lit(number).alias("round"), "pass", "table", "id", "column", "was", "now"))
        log = round_ if log is None else log.unionByName(round_)
        if round_.isEmpty():
            return Settled(now.with_(events=plain(now.events)), log, number)
        # The log of a round rides along in its events; the next round starts with an empty one.
        fresh = files.saved(now.events.withColumn("_log", F.expr(f"cast(array() as array<{ENTRY}>)"))) if now.events is not catalog.events else now.events
        files.drop(*(getattr(catalog, t) for t in Catalog.TABLES if getattr(now, t) is not getattr(catalog, t)))
        if fresh is not now.events:
            files.drop(now.events)
        catalog = now.with_(events=fresh)
    raise Unsettled(f"rows still change after {most} rounds")


def by_values(steps: list[tuple[str, Pass]]) -> bool:
    """Whether each pass judges single rows, and those of a table all keep rows or, of events, all change them."""
    if not all(isinstance(step, RowPass) for _, step in steps):
        return False
    changing, keeping = ({step.table for _, step in steps if (step.change is None) == kept_} for kept_ in (False, True))
    return changing <= {"events"} and not changing & keeping


def apart(steps: list[tuple[str, RowPass]]) -> list[list[tuple[str, RowPass]]]:
    """The passes in groups, each in order: no pass reads or writes what one of another group writes, so groups settle by themselves."""
    meet = lambda a, b: set(a.writes) & {*b.reads, *b.writes} or set(b.writes) & set(a.reads)
    groups: list[list[int]] = []
    for i, (_, step) in enumerate(steps):
        near = [g for g in groups if any(meet(step, steps[k][1]) for k in g)]
        groups = [g for g in groups if g not in near] + [sorted([*(k for g in near for k in g), i])]
    return [[steps[k] for k in g] for g in groups]


#: Sets of values up to which they go to the tasks, so that one which most rows have needs no place of its own.
FEW = 10_000


def settled_values(rows: DataFrame, steps: list[tuple[str, RowPass]], most: int) -> tuple[DataFrame | None, int]:
    """(_at, _now, _log) of each distinct set of values that the passes change, and the number of rounds, the last one without a change.

    _at: the values of the columns read or written; _now: those written, once no pass changes them; _log: the changes, with
    their rounds. Sets that a round leaves as they are have settled; only the others are judged again.
    """
    files = Steps(rows.sparkSession)
    written_ = [c for c in rows.columns if any(c in step.writes for _, step in steps)]
    read = [c for c in rows.columns if c in written_ or any(c in step.reads for _, step in steps)]
    nothing = F.expr(f"cast(array() as array<{ROUND_ENTRY}>)")
    active = rows.select(F.struct(*read).alias("_at")).distinct().select("_at", *(F.col(f"_at.{c}").alias(c) for c in written_), nothing.alias("_log"))
    done = []
    for number in range(1, most + 1):
        now = active.select("_at", *(F.col(c) if c in written_ else F.col(f"_at.{c}").alias(c) for c in read), "_log", nothing.alias("_new"))
        for name, step in steps:
            after = step.change(now.withColumns({f"_was_{c}": F.col(c) for c in step.writes}))
            entry = lambda c: F.struct(F.lit(number).alias("round"), F.lit(name).alias("pass"), F.lit(c).alias("column"), F.col(f"_was_{c}").cast("string").alias("was"), F.col(c).cast("string").alias("now"))  # noqa: E731, B023
            found = F.array_compact(F.array(*(F.when(~F.col(f"_was_{c}").eqNullSafe(F.col(c)), entry(c)) for c in step.writes)))
            now = after.withColumn("_new", F.concat("_new", found)).drop(*(f"_was_{c}" for c in step.writes))
        now = now.select("_at", *written_, F.concat("_log", "_new").alias("_log"), (F.size("_new") > 0).alias("_on"))
        out = files.saved(now)  # whole: a filter here would be pushed below distinct, and the passes with it to each row
        done.append(out.filter("not _on and size(_log) > 0").select("_at", F.struct(*written_).alias("_now"), "_log"))
        active = out.filter("_on").drop("_on")
        if active.isEmpty():
            return (reduce(DataFrame.unionByName, done) if number > 1 else None), number
    raise Unsettled(f"rows still change after {most} rounds")


def settled_rows(catalog: Catalog, steps: list[tuple[str, RowPass]], most: int) -> Settled:
    """settled, by passes that judge single rows. What the passes make of events is worked out once for each distinct set of the values that they read, and told to the rows; the other columns and the rows that are kept are those of the given tables."""
    text_ = lambda v=None: F.lit(v).cast("string")
    now, rounds = catalog, 1
    changes = catalog.events.sparkSession.createDataFrame([], f"round int, {CHANGE}")
    for t in Catalog.TABLES:
        mine = [(name, step) for name, step in steps if step.table == t]
        rows = getattr(catalog, t)
        if not mine:
            continue
        if mine[0][1].change is None:
            stays = F.coalesce(reduce(lambda a, b: a & b, (step.keep for _, step in mine)), F.lit(False))
            gone = rows.filter(~stays)
            if gone.isEmpty():
                continue
            rounds, key = max(rounds, 2), KEYS.get(t, ["id"])
            removed = row_changes(gone.select(*key), gone.select(*key).limit(0), t, key)
            found = removed.select(F.lit(1).alias("round"), text_().alias("pass"), "table", "id", text_().alias("column"), text_().alias("was"), "now")
            now = now.with_(**{t: rows.filter(stays)})
            changes = changes.unionByName(found)
        for group in apart(mine) if mine[0][1].change is not None else []:
            values, number = settled_values(rows, group, most)
            rounds = max(rounds, number)
            if values is None:
                continue
            # Merged by a hash too, as structs are slow to sort; only few are broadcast, as packed files look smaller than they are.
            values = values.withColumn("_hash", F.xxhash64("_at"))
            values = values.hint("broadcast" if values.limit(FEW + 1).count() <= FEW else "merge")
            at = F.struct(*values.schema["_at"].dataType.names)
            keyed = lambda df: df.withColumns({"_at": at, "_hash": F.xxhash64(at)})  # noqa: E731, B023
            told = keyed(getattr(now, t)).join(values.select("_hash", "_at", "_now"), ["_hash", "_at"], "left")
            new = {c: F.when(F.col("_now").isNotNull(), F.col(f"_now.{c}")).otherwise(F.col(c)).alias(c) for c in values.schema["_now"].dataType.names}
            now = now.with_(**{t: told.select(*(new.get(c, F.col(c)) for c in rows.columns))})
            logged = keyed(rows).select("id", "_hash", "_at").join(values.select("_hash", "_at", "_log"), ["_hash", "_at"])
            found = logged.select("id", F.explode("_log").alias("e")).select("e.round", "e.pass", F.lit(t).alias("table"), "id", "e.column", "e.was", "e.now")
            changes = changes.unionByName(found)
    if rounds > most:
        raise Unsettled(f"rows still change after {most} rounds")
    return Settled(now, changes, rounds)


def changed_rows(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """(change, n) between two states of a table: added, removed, changed."""
    mark = lambda df, name: df.select(key, F.xxhash64(*sorted(df.columns)).alias(name))
    both = mark(before, "_b").join(mark(after, "_a"), key, "full_outer")
    kind = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return both.withColumn("change", kind).filter("change is not null").groupBy("change").agg(F.count("*").alias("n"))

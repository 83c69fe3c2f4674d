"""Catalog dumps of a fleet of databases, derived by Spark from the customer table.

Every customer owns one database of each dialect, so a dialect's dump grows with the whole table. Rows
come from exploding the constant seed on each customer, without a join.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleet import seed
from lakescribe.model import LazyFrames
from lakescribe.sources.native import NATIVE, native_schema

Frames = Mapping[str, DataFrame]

TABLE_OF = {t[0]: t for t in seed.TABLES}
NAMES = {**{t[0]: t[1] for t in seed.TABLES}, seed.VIEW[0]: seed.VIEW[1]}
ROLES = {**{t[0]: t[2] for t in seed.TABLES}, seed.VIEW[0]: seed.VIEW[2]}
COLUMN_NAMES = {(c[0], c[1]): c[2] for c in seed.COLUMNS}


def sources(customer: DataFrame, dialect: str) -> DataFrame:
    """One row per database, with what makes it differ from the others.

    Few bytes of customers become many rows, so they are dealt out first: a file of millions is one task's read.
    """
    database = F.concat(F.lit("Pegeldienst_"), F.col("c_custkey").cast("string"))
    archive = {"postgresql": F.lit("public"), "mysql": database, "oracle": F.lit("PEGEL_ARC"), "mssql": F.lit("dbo")}
    segment = F.col("c_mktsegment")
    return customer.repartition("c_custkey").select(
        (F.col("c_custkey") * 4 + seed.DIALECT_CODES[dialect]).alias("source_id"),
        F.col("c_custkey").alias("k"),
        database.alias("database_name"),
        F.when(F.col("c_nationkey") < 20, F.lit("PEGEL")).otherwise(F.lit("PEGEL2")).alias("main_owner"),
        archive[dialect].alias("archive_owner"),
        F.lit(seed.SYSTEM_OWNER[dialect]).alias("system_owner"),
        (segment != seed.NO_TRIGGERS).alias("has_triggers"),
        (F.col("c_acctbal") >= 0).alias("has_synonyms"),
        (segment == seed.RENAMES).alias("renames"),
        (segment == seed.UPDATABLE).alias("updatable"),
        (segment == seed.CYCLIC).alias("cyclic"),
    )


class _Dump:
    """Collects how the native relations of one dialect are built from seed rows."""

    def __init__(self, customer: DataFrame, dialect: str):
        self.base, self.dialect = sources(customer, dialect), dialect
        self.builders: dict[str, Callable[[], DataFrame]] = {}

    def frames(self) -> Frames:
        return LazyFrames(self.builders)

    def add(
        self,
        relation: str,
        rows: list[dict],
        fields: str,
        /,
        where: str | None = None,
        drop: Callable[[], Column] | None = None,
        **values: Column,
    ) -> None:
        """`fields` types the seed rows; columns of the relation are taken from `values` or by name.
        `where` chooses sources, `drop` leaves out built rows."""

        def build() -> DataFrame:
            # A constant that the optimizer folds to one array.
            array = F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), f"array<struct<{fields}>>")
            base = self.base.where(where) if where else self.base
            wide = base.select("*", F.inline(array))
            schema = native_schema(self.dialect, relation)
            built = wide.select(*[
                values[f.name].cast(f.dataType).alias(f.name) if f.name in values else f.name for f in schema.fields
            ]).to(schema)
            return built.where(~drop()) if drop else built

        self.builders[relation] = build


def _owner(role: str = "role") -> Column:
    role_ = F.col(role)
    return (
        F.when(role_ == seed.MAIN, F.col("main_owner"))
        .when(role_ == seed.ARCHIVE, F.col("archive_owner"))
        .when(role_ == seed.SYSTEM, F.col("system_owner"))
        .otherwise(role_)
    )


def _column_name(name: str = "cname") -> Column:
    old = COLUMN_NAMES[seed.RENAMED[:2]]
    return F.when(F.col("renames") & (F.col(name) == old), F.lit(seed.RENAMED[2])).otherwise(F.col(name))


def _blank(position: str) -> Column:
    """Whether a landed column comment is one of those that this source lacks."""
    return (F.floor(F.col("source_id") / 4) + F.col(position)) % 3 == 0


def _comment(missing: Column) -> Column:
    """Column comment of this source, or the dialect's form of none."""
    blank = _blank("pos") | (F.col("note") == "")
    return F.when(blank, missing).otherwise(F.col("note"))


def _rows_of(table: tuple) -> dict:
    number, name, role, rows, comment, created, modified = table
    return {"t": number, "tname": name, "role": role, "n": rows, "note": comment, "created": created, "modified": modified}


_TABLE_FIELDS = "t int, tname string, role string, n long, note string, created string, modified string"


def _column_rows(dialect: str) -> list[dict]:
    out = []
    for t, pos, name, kind, nullable, note in seed.COLUMNS:
        text, length, precision, scale = seed.TYPES[kind][dialect]
        out.append({
            "t": t, "tname": NAMES[t], "role": ROLES[t], "pos": pos, "cname": name, "dtype": text, "len": length,
            "prec": precision, "sc": scale, "nullable_": nullable, "note": note,
            "dflt": seed.DEFAULTS.get((t, pos), {}).get(dialect), "auto": (t, pos) == seed.AUTO_INCREMENT,
        })
    return out


_COLUMN_FIELDS = (
    "t int, tname string, role string, pos int, cname string, dtype string, len int, prec int, sc int, "
    "nullable_ boolean, note string, dflt string, auto boolean"
)


def _info(dump: _Dump) -> None:
    rows = [{"line": i, "version": v} for i, v in enumerate(seed.VERSIONS[dump.dialect], start=1)]
    dump.add("database_info", rows, "line int, version string")


def postgresql(customer: DataFrame) -> Frames:
    d = _Dump(customer, "postgresql")
    _info(d)
    roles = {seed.ARCHIVE: 2200, seed.MAIN: 2300, seed.SYSTEM: 11}
    d.add("pg_namespace", [{"oid": oid, "role": r} for r, oid in roles.items()], "oid long, role string", nspname=_owner())
    oid = lambda n: 16000 + n
    relations = [
        {"oid": oid(t), "relname": name, "relnamespace": roles[role], "relkind": "r", "n": rows}
        for t, name, role, rows, *_ in seed.TABLES
    ]
    relations.append({"oid": oid(8), "relname": seed.VIEW[1], "relnamespace": roles[seed.MAIN], "relkind": "v"})
    # Kinds that are left out by default.
    relations.append({"oid": oid(9), "relname": "Jahresmittel", "relnamespace": roles[seed.MAIN], "relkind": "m"})
    relations.append({"oid": oid(10), "relname": "Ablesung_alt", "relnamespace": roles[seed.MAIN], "relkind": "p"})
    relations += [
        {"oid": oid(i), "relname": name, "relnamespace": roles[ROLES[t]], "relkind": "i", "relam": 403}
        for i, t, name, *_ in seed.INDEXES
    ]
    relations += [
        {"oid": oid(i), "relname": name, "relnamespace": roles[seed.MAIN], "relkind": "S"} for i, name, *_ in seed.SEQUENCES
        if i != 43  # PostgreSQL sequences end at 64 bits
    ]
    d.add("pg_class", relations, "oid long, relname string, relnamespace long, relkind string, relam long, n long",
          live_tuples=F.col("n") + F.col("k"))
    notes = [{"o": oid(t[0]), "s": 0, "c": "pg_class", "note": t[4]} for t in seed.TABLES]
    notes.append({"o": oid(8), "s": 0, "c": "pg_class", "note": seed.VIEW[3]})
    notes += [{"o": oid(i[0]), "s": 0, "c": "pg_class", "note": i[6]} for i in seed.INDEXES]
    notes += [{"o": oid(s[0]), "s": 0, "c": "pg_class", "note": s[7]} for s in seed.SEQUENCES]
    notes += [{"o": oid(r[0]), "s": 0, "c": "pg_proc", "note": r[3]} for r in seed.ROUTINES]
    # The same oid in another catalog is another object.
    notes.append({"o": oid(1), "s": 0, "c": "pg_proc", "note": "anderes Objekt"})
    notes += [{"o": oid(t[0]), "s": 0, "c": "pg_trigger", "note": t[7]} for t in seed.TRIGGERS]
    notes += [{"o": oid(c[0]), "s": c[1], "c": "pg_class", "note": c[5]} for c in seed.COLUMNS]
    d.add("pg_description", [n for n in notes if n["note"]], "o long, s int, c string, note string",
          objoid=F.col("o"), objsubid=F.col("s"), classname=F.col("c"), description=F.col("note"),
          drop=lambda: (F.col("objsubid") > 0) & _blank("objsubid"))
    attributes = _column_rows("postgresql")
    hidden = {"role": seed.MAIN, "dtype": "tid", "nullable_": False, "note": ""}
    attributes.append({**hidden, "t": 2, "pos": 5, "cname": "........pg.dropped.5........", "dropped": True})
    attributes.append({**hidden, "t": 2, "pos": -1, "cname": "ctid"})
    for table in (9, 10):
        attributes.append({**hidden, "t": table, "pos": 1, "cname": "Spalte", "dtype": "text"})
    d.add("pg_attribute", attributes, _COLUMN_FIELDS + ", dropped boolean",
          attrelid=F.col("t") + 16000, attnum=F.col("pos"), attname=_column_name(), format_type=F.col("dtype"),
          attnotnull=~F.col("nullable_"), attisdropped=F.coalesce("dropped", F.lit(False)))
    d.add("pg_attrdef", [c for c in attributes if c.get("dflt")], _COLUMN_FIELDS,
          adrelid=F.col("t") + 16000, adnum=F.col("pos"), expr_text=F.col("dflt"))
    d.add("pg_index",
          [{"indexrelid": oid(i), "indrelid": oid(t), "indkey": key, "indisunique": u, "indisprimary": p}
           for i, t, _, key, u, p, _ in seed.INDEXES], NATIVE["postgresql"]["pg_index"])
    d.add("pg_am", [{"oid": 403, "amname": "btree"}], NATIVE["postgresql"]["pg_am"])
    d.add("pg_constraint",
          [{"conname": n, "conrelid": oid(c), "confrelid": oid(p), "conkey": ck, "confkey": pk, "contype": "f"}
           for n, c, ck, p, pk in seed.FOREIGN_KEYS]
          + [{"conname": "CK_Kilometer", "conrelid": oid(1), "conkey": [4], "contype": "c"}],
          NATIVE["postgresql"]["pg_constraint"])
    d.add("views", [{"table_name": seed.VIEW[1]}], "table_name string", table_schema=F.col("main_owner"),
          is_updatable=F.when(F.col("updatable"), F.lit("YES")).otherwise(F.lit("NO")))
    pg_type = lambda kind: seed.TYPES[kind]["postgresql"][0]
    routines = [
        {"oid": oid(i), "proname": name, "pronamespace": 2300, "prokind": kind[0].lower(),
         "identity_args": ", ".join(f"{a} {pg_type(t)}" for a, _, t in args),
         "return_type": pg_type(ret) if ret else "void", "prolang": 13}
        for i, name, kind, _, args, ret in seed.ROUTINES
    ]
    routines.append({**routines[1], "oid": oid(33), "identity_args": "p_name text"})  # an overload
    routines.append({**routines[1], "oid": oid(34), "proname": "Gesamt", "prokind": "a"})  # left out
    d.add("pg_proc", routines, NATIVE["postgresql"]["pg_proc"])
    d.add("pg_language", [{"oid": 13, "lanname": "plpgsql"}], NATIVE["postgresql"]["pg_language"])
    d.add("pg_sequences", _sequence_rows(big=False), _SEQUENCE_FIELDS,
          seqrelid=F.col("i") + 16000, seqmin=F.col("lo"), seqmax=F.col("hi"), seqincrement=F.col("step"),
          last_value=F.col("last"), seqcycle=F.col("cyclic") & (F.col("i") == 42))
    bits = {"INSERT": 4, "DELETE": 8, "UPDATE": 16, "BEFORE": 2, "INSTEAD OF": 64, "AFTER": 0, "ROW": 1, "STATEMENT": 0}
    triggers = [
        {"oid": oid(i), "tgname": name, "tgrelid": oid(t),
         "tgtype": bits[timing] + bits[level] + sum(bits[e] for e in events),
         "tgenabled": "O" if on else "D", "tgisinternal": False}
        for i, name, t, timing, events, level, on, _ in seed.TRIGGERS
    ]
    triggers.append({**triggers[0], "oid": oid(59), "tgname": "RI_trigger", "tgisinternal": True})  # left out
    d.add("pg_trigger", triggers, NATIVE["postgresql"]["pg_trigger"], where="has_triggers")
    return d.frames()


_SEQUENCE_FIELDS = "i int, sname string, lo string, hi string, step string, last string, cache int, note string"


def _sequence_rows(big: bool) -> list[dict]:
    return [
        {"i": i, "sname": n, "lo": str(lo), "hi": str(hi), "step": str(step), "last": str(last), "cache": cache, "note": note}
        for i, n, lo, hi, step, last, cache, note in seed.SEQUENCES if big or i != 43
    ]


def mysql(customer: DataFrame) -> Frames:
    d = _Dump(customer, "mysql")
    _info(d)
    owner = _owner()
    tables = [{**_rows_of(t), "kind": "BASE TABLE", "engine": "InnoDB"} for t in seed.TABLES]
    tables.append({"t": 8, "tname": seed.VIEW[1], "role": seed.MAIN, "kind": "VIEW", "note": "VIEW"})
    d.add("tables", tables, _TABLE_FIELDS + ", kind string, engine string",
          table_schema=owner, table_name=F.col("tname"), table_type=F.col("kind"), table_rows=F.col("n") + F.col("k"),
          table_comment=F.col("note"), create_time=F.col("created"), update_time=F.col("modified"))
    keys = {(2, 4): None}
    for _, t, _, positions, unique, primary, _ in seed.INDEXES:
        for place, pos in enumerate(positions):
            code = "PRI" if primary else "UNI" if unique and len(positions) == 1 else "MUL" if place == 0 else None
            rank = ["PRI", "UNI", "MUL", None]
            keys[(t, pos)] = min(keys.get((t, pos)), code, key=rank.index)
    columns = [{**c, "ckey": keys.get((c["t"], c["pos"])) or ""} for c in _column_rows("mysql")]
    zero_null = lambda c: F.when(F.col(c) > 0, F.col(c))
    d.add("columns", columns, _COLUMN_FIELDS + ", ckey string",
          table_schema=owner, table_name=F.col("tname"), column_name=_column_name(), ordinal_position=F.col("pos"),
          data_type=F.col("dtype"), character_maximum_length=zero_null("len"), numeric_precision=zero_null("prec"),
          numeric_scale=F.when(F.col("prec") > 0, F.col("sc")),
          is_nullable=F.when(F.col("nullable_"), F.lit("YES")).otherwise(F.lit("NO")), column_default=F.col("dflt"),
          column_comment=_comment(F.lit("")), column_key=F.col("ckey"),
          extra=F.when(F.col("auto"), F.lit("auto_increment")).otherwise(F.lit("")))
    usage = [
        {"con": n, "tname": NAMES[c], "role": ROLES[c], "cname": COLUMN_NAMES[(c, cp)],
         "ptable": NAMES[p], "pcolumn": COLUMN_NAMES[(p, pp)]}
        for n, c, cps, p, pps in seed.FOREIGN_KEYS for cp, pp in zip(cps, pps, strict=True)
    ]
    usage += [
        {"con": "PRIMARY", "tname": NAMES[t], "role": ROLES[t], "cname": COLUMN_NAMES[(t, pos)]}
        for _, t, _, positions, _, primary, _ in seed.INDEXES if primary for pos in positions
    ]
    d.add("key_column_usage", usage,
          "con string, tname string, role string, cname string, ptable string, pcolumn string",
          constraint_name=F.col("con"), table_schema=owner, table_name=F.col("tname"), column_name=F.col("cname"),
          referenced_table_name=F.col("ptable"), referenced_column_name=F.col("pcolumn"))
    statistics = [
        {"tname": NAMES[t], "role": ROLES[t], "iname": "PRIMARY" if primary else name, "non_unique": int(not unique),
         "seq_in_index": place, "cname": COLUMN_NAMES[(t, pos)]}
        for _, t, name, positions, unique, primary, _ in seed.INDEXES for place, pos in enumerate(positions, start=1)
    ]
    # Landed out of order: position decides, not arrival.
    d.add("statistics", statistics[::-1],
          "tname string, role string, iname string, non_unique int, seq_in_index int, cname string",
          table_schema=owner, table_name=F.col("tname"), index_name=F.col("iname"), index_type=F.lit("BTREE"),
          column_name=F.col("cname"))
    d.add("views", [{"table_name": seed.VIEW[1]}], "table_name string", table_schema=F.col("main_owner"),
          is_updatable=F.when(F.col("updatable"), F.lit("YES")).otherwise(F.lit("NO")))
    my_type = lambda kind: seed.TYPES[kind]["mysql"][0]
    d.add("routines",
          [{"routine_name": n, "routine_type": k, "routine_comment": note, "dtd_identifier": my_type(r) if r else None}
           for _, n, k, note, _, r in seed.ROUTINES] + [{"routine_name": seed.ROUTINES[1][1], "routine_type": "PROCEDURE"}],
          "routine_name string, routine_type string, routine_comment string, dtd_identifier string",
          routine_schema=F.col("main_owner"))
    parameters = [
        {"specific_name": n, "routine_type": k, "parameter_name": a, "ordinal_position": i, "parameter_mode": m, "data_type": my_type(t)}
        for _, n, k, _, args, _ in seed.ROUTINES for i, (a, m, t) in enumerate(args, start=1)
    ]
    # A procedure with the name of a function.
    parameters.append({"specific_name": seed.ROUTINES[1][1], "routine_type": "PROCEDURE", "parameter_name": "p_out",
                       "ordinal_position": 1, "parameter_mode": "OUT", "data_type": "int"})
    # The return value is a parameter without a name.
    parameters += [{"specific_name": n, "routine_type": k, "ordinal_position": 0, "data_type": my_type(r)}
                   for _, n, k, _, _, r in seed.ROUTINES if r]
    d.add("parameters", parameters[::-1],
          "specific_name string, routine_type string, parameter_name string, ordinal_position int, parameter_mode string, "
          "data_type string",
          specific_schema=F.col("main_owner"))
    # One event per trigger, tables only.
    d.add("triggers",
          [{"trigger_name": n, "event_object_table": NAMES[t], "action_timing": timing, "event_manipulation": events[0]}
           for _, n, t, timing, events, *_ in seed.TRIGGERS if t != 8],
          "trigger_name string, event_object_table string, action_timing string, event_manipulation string",
          where="has_triggers", trigger_schema=F.col("main_owner"), event_object_schema=F.col("main_owner"))
    return d.frames()


def oracle(customer: DataFrame) -> Frames:
    d = _Dump(customer, "oracle")
    _info(d)
    owner = _owner()
    table = {"owner": owner, "table_name": F.col("tname")}
    d.add("all_tables", [_rows_of(t) for t in seed.TABLES], _TABLE_FIELDS, **table,
          num_rows=F.col("n") + F.col("k"), created=F.col("created"), last_ddl_time=F.col("modified"))
    notes = [{"tname": t[1], "role": t[2], "note": t[4] or None} for t in seed.TABLES]
    notes.append({"tname": seed.VIEW[1], "role": seed.MAIN, "note": seed.VIEW[3]})
    notes += [{"tname": r[1], "role": seed.MAIN, "note": r[3]} for r in seed.ROUTINES]
    d.add("all_tab_comments", notes, "tname string, role string, note string", **table, comments=F.col("note"))
    padded = F.concat(F.col("dflt"), F.lit("  "))
    zero_null = lambda c: F.when(F.col(c) > 0, F.col(c))
    columns = _column_rows("oracle")
    d.add("all_tab_columns", columns, _COLUMN_FIELDS, **table,
          column_name=_column_name(), column_id=F.col("pos"), data_type=F.col("dtype"),
          data_length=F.lit(22), data_precision=zero_null("prec"), data_scale=F.when(F.col("prec") > 0, F.col("sc")),
          nullable=F.when(F.col("nullable_"), F.lit("Y")).otherwise(F.lit("N")), data_default=padded,
          char_col_decl_length=zero_null("len"))
    d.add("all_col_comments", columns, _COLUMN_FIELDS, **table, column_name=_column_name(),
          comments=_comment(F.lit(None)))
    constraints, parts = [], []
    for _, t, name, positions, unique, primary, _ in seed.INDEXES:
        if unique:
            constraints.append({"con": name, "ctype": "P" if primary else "U", "tname": NAMES[t], "role": ROLES[t]})
            parts += [{"con": name, "tname": NAMES[t], "role": ROLES[t], "cname": COLUMN_NAMES[(t, p)], "position": i}
                      for i, p in enumerate(positions, start=1)]
    # The parent key's own columns are in another order than the composite foreign key lists them.
    for name, c, child, p, parent in seed.FOREIGN_KEYS:
        target = next(i for i in seed.INDEXES if i[1] == p and i[5])
        constraints.append({"con": name, "ctype": "R", "tname": NAMES[c], "role": ROLES[c], "rrole": ROLES[p], "rcon": target[2]})
        parts += [{"con": name, "tname": NAMES[c], "role": ROLES[c], "cname": COLUMN_NAMES[(c, cp)],
                   "position": target[3].index(pp) + 1} for cp, pp in zip(child, parent, strict=True)]
    constraints.append({"con": "CK_Kilometer", "ctype": "C", "tname": NAMES[1], "role": seed.MAIN})
    parts.append({"con": "CK_Kilometer", "tname": NAMES[1], "role": seed.MAIN, "cname": "Kilometer"})
    d.add("all_constraints", constraints, "con string, ctype string, tname string, role string, rrole string, rcon string",
          **table, constraint_name=F.col("con"), constraint_type=F.col("ctype"), r_owner=_owner("rrole"),
          r_constraint_name=F.col("rcon"))
    d.add("all_cons_columns", parts, "con string, tname string, role string, cname string, position int",
          **table, constraint_name=F.col("con"), column_name=F.col("cname"))
    indexes = [{"iname": n, "tname": NAMES[t], "role": ROLES[t], "uniq": "UNIQUE" if u else "NONUNIQUE", "note": note}
               for _, t, n, _, u, _, note in seed.INDEXES]
    fields = "iname string, tname string, role string, uniq string, note string"
    d.add("all_indexes", indexes, fields, owner=owner, index_name=F.col("iname"), table_owner=owner,
          table_name=F.col("tname"), index_type=F.lit("NORMAL"), uniqueness=F.col("uniq"))
    d.add("all_ind_comments", [i for i in indexes if i["note"]], fields, owner=owner, index_name=F.col("iname"),
          comments=F.col("note"))
    d.add("all_ind_columns",
          [{"role": ROLES[t], "iname": n, "cname": COLUMN_NAMES[(t, p)], "column_position": i}
           for _, t, n, positions, *_ in seed.INDEXES for i, p in enumerate(positions, start=1)][::-1],
          "role string, iname string, cname string, column_position int",
          index_owner=owner, index_name=F.col("iname"), column_name=F.col("cname"))
    d.add("all_views", [{"view_name": seed.VIEW[1]}], "view_name string", owner=F.col("main_owner"),
          read_only=F.when(F.col("updatable"), F.lit("N")).otherwise(F.lit("Y")))
    procedures = [{"object_name": n, "object_type": k} for _, n, k, *_ in seed.ROUTINES]
    # A package: itself (left out), a procedure, its overload, a function.
    procedures.append({"object_name": "Auswertung", "object_type": "PACKAGE", "subprogram_id": 0})
    for number, member in enumerate(("Ganglinie", "Ganglinie", "Summe"), start=1):
        procedures.append({"object_name": "Auswertung", "procedure_name": member, "object_type": "PACKAGE", "subprogram_id": number})
    d.add("all_procedures", procedures, "object_name string, procedure_name string, object_type string, subprogram_id int",
          owner=F.col("main_owner"))
    ora_type = lambda kind: seed.TYPES[kind]["oracle"][0]
    arguments = [
        {"object_name": n, "argument_name": a, "position": i, "in_out": m, "data_type": ora_type(t)}
        for _, n, _, _, args, _ in seed.ROUTINES for i, (a, m, t) in enumerate(args, start=1)
    ]
    arguments += [{"object_name": n, "position": 0, "in_out": "OUT", "data_type": ora_type(r)} for _, n, _, _, _, r in seed.ROUTINES if r]
    member = {"package_name": "Auswertung", "in_out": "IN", "data_type": "NUMBER"}
    arguments += [
        {**member, "object_name": "Ganglinie", "subprogram_id": 1, "argument_name": "p_monat", "position": 1, "default_value": "1"},
        {**member, "object_name": "Ganglinie", "subprogram_id": 2, "argument_name": "p_monat", "position": 1},
        {**member, "object_name": "Ganglinie", "subprogram_id": 2, "argument_name": "p_jahr", "position": 2},
        {**member, "object_name": "Summe", "subprogram_id": 3, "position": 0, "in_out": "OUT"},
        {**member, "object_name": "Summe", "subprogram_id": 3, "argument_name": "p_monat", "position": 1},
    ]
    d.add("all_arguments", arguments[::-1],
          "object_name string, package_name string, subprogram_id int, argument_name string, position int, in_out string, "
          "data_type string, default_value string", owner=F.col("main_owner"))
    d.add("all_sequences", _sequence_rows(big=True), _SEQUENCE_FIELDS,
          sequence_owner=F.col("main_owner"), sequence_name=F.col("sname"), min_value=F.col("lo"), max_value=F.col("hi"),
          increment_by=F.col("step"), last_number=F.col("last"), cache_size=F.col("cache"),
          cycle_flag=F.when(F.col("cyclic") & (F.col("i") == 42), F.lit("Y")).otherwise(F.lit("N")),
          order_flag=F.when(F.col("i") == 43, F.lit("Y")).otherwise(F.lit("N")))
    d.add("all_triggers",
          [{"trigger_name": n, "table_name": NAMES[t], "status": "ENABLED" if on else "DISABLED",
            "trigger_type": timing if timing == "INSTEAD OF" else f"{timing} {'EACH ROW' if level == 'ROW' else level}",
            "triggering_event": " OR ".join(events)}
           for _, n, t, timing, events, level, on, _ in seed.TRIGGERS],
          "trigger_name string, table_name string, status string, trigger_type string, triggering_event string",
          where="has_triggers", owner=F.col("main_owner"), table_owner=F.col("main_owner"))
    d.add("all_synonyms", [{"synonym_name": n, "table_name": NAMES[t]} for _, n, t, _ in seed.SYNONYMS],
          "synonym_name string, table_name string", where="has_synonyms",
          owner=F.when(F.col("synonym_name") == "READING", F.col("main_owner")).otherwise(F.lit("PUBLIC")),
          table_owner=F.col("main_owner"), db_link=F.lit(None))
    return d.frames()


def mssql(customer: DataFrame) -> Frames:
    d = _Dump(customer, "mssql")
    _info(d)
    schema_ids = {seed.ARCHIVE: 1, seed.MAIN: 5, seed.SYSTEM: 4}
    d.add("schemas", [{"schema_id": i, "role": r} for r, i in schema_ids.items()], "schema_id int, role string", name=_owner())
    oid = lambda n: 9000 + n
    d.add("tables", [{**_rows_of(t), "schema_id": schema_ids[t[2]]} for t in seed.TABLES], _TABLE_FIELDS + ", schema_id int",
          object_id=F.col("t") + 9000, name=F.col("tname"), type_desc=F.lit("USER_TABLE"), create_date=F.col("created"),
          modify_date=F.col("modified"))
    # Two partitions of the base data, and an index that must not be counted.
    partitions = []
    for t, _, _, rows, *_ in seed.TABLES:
        if rows is not None:
            partitions += [{"t": t, "index_id": 1, "n": rows - 1, "plus": False}, {"t": t, "index_id": 0, "n": 1, "plus": True},
                           {"t": t, "index_id": 2, "n": rows, "plus": False}]
    d.add("partitions", partitions, "t int, index_id int, n long, plus boolean", object_id=F.col("t") + 9000,
          rows=F.when(F.col("plus"), F.col("n") + F.col("k")).otherwise(F.col("n")))
    index_ids = {}
    for i, t, *_ in seed.INDEXES:
        index_ids[i] = 1 + sum(1 for j in index_ids if next(x for x in seed.INDEXES if x[0] == j)[1] == t)
    notes = [{"class": 1, "o": oid(t[0]), "pos": 0, "note": t[4]} for t in seed.TABLES]
    notes.append({"class": 1, "o": oid(8), "pos": 0, "note": seed.VIEW[3]})
    notes += [{"class": 1, "o": oid(c[0]), "pos": c[1], "note": c[5]} for c in seed.COLUMNS]
    notes += [{"class": 7, "o": oid(i[1]), "pos": index_ids[i[0]], "note": i[6]} for i in seed.INDEXES]
    notes += [{"class": 1, "o": oid(r[0]), "pos": 0, "note": r[3]} for r in seed.ROUTINES]
    notes += [{"class": 1, "o": oid(s[0]), "pos": 0, "note": s[7]} for s in seed.SEQUENCES]
    notes += [{"class": 1, "o": oid(t[0]), "pos": 0, "note": t[7]} for t in seed.TRIGGERS]
    notes += [{"class": 1, "o": oid(s[0]), "pos": 0, "note": s[3]} for s in seed.SYNONYMS]
    d.add("extended_properties", [n for n in notes if n["note"]], "class int, o long, pos int, note string",
          major_id=F.col("o"), minor_id=F.col("pos"), name=F.lit("MS_Description"), value=F.col("note"),
          drop=lambda: (F.col("class") == 1) & (F.col("minor_id") > 0) & _blank("minor_id"))
    type_names = sorted({t["mssql"][0] for t in seed.TYPES.values()})
    type_ids = {name: 100 + i for i, name in enumerate(type_names)}
    columns = [{**c, "type_id": type_ids[c["dtype"]]} for c in _column_rows("mssql")]
    d.add("columns", columns, _COLUMN_FIELDS + ", type_id int",
          object_id=F.col("t") + 9000, column_id=F.col("pos"), name=_column_name(), user_type_id=F.col("type_id"),
          max_length=F.col("len"), precision=F.col("prec"), scale=F.col("sc"), is_nullable=F.col("nullable_"),
          is_identity=F.col("auto"))
    d.add("types", [{"user_type_id": i, "name": n} for n, i in type_ids.items()], NATIVE["mssql"]["types"])
    d.add("default_constraints", [c for c in columns if c["dflt"]], _COLUMN_FIELDS,
          parent_object_id=F.col("t") + 9000, parent_column_id=F.col("pos"), default_text=F.col("dflt"))
    indexes = [
        {"object_id": oid(t), "index_id": index_ids[i], "name": n, "is_unique": u, "is_primary_key": p,
         "type_desc": "CLUSTERED" if p else "NONCLUSTERED"} for i, t, n, _, u, p, _ in seed.INDEXES
    ]
    indexes.append({"object_id": oid(7), "index_id": 0, "type_desc": "HEAP", "is_unique": False, "is_primary_key": False})
    d.add("indexes", indexes, NATIVE["mssql"]["indexes"])
    d.add("index_columns",
          [{"object_id": oid(t), "index_id": index_ids[i], "column_id": p, "key_ordinal": place}
           for i, t, _, positions, *_ in seed.INDEXES for place, p in enumerate(positions, start=1)][::-1],
          NATIVE["mssql"]["index_columns"])
    keys, key_columns = [], []
    for i, (n, c, cps, p, pps) in enumerate(seed.FOREIGN_KEYS, start=71):
        keys.append({"object_id": oid(i), "name": n, "parent_object_id": oid(c), "referenced_object_id": oid(p)})
        key_columns += [{"constraint_object_id": oid(i), "parent_object_id": oid(c), "parent_column_id": cp,
                         "referenced_column_id": pp} for cp, pp in zip(cps, pps, strict=True)]
    d.add("foreign_keys", keys, NATIVE["mssql"]["foreign_keys"])
    d.add("foreign_key_columns", key_columns, NATIVE["mssql"]["foreign_key_columns"])
    d.add("views", [{"object_id": oid(8), "schema_id": 5, "name": seed.VIEW[1]}], "object_id long, schema_id int, name string",
          has_instead_of=F.col("updatable"))
    d.add("procedures",
          [{"object_id": oid(i), "schema_id": 5, "name": n, "type_desc": "SQL_STORED_PROCEDURE"}
           for i, n, k, *_ in seed.ROUTINES if k == "PROCEDURE"], NATIVE["mssql"]["procedures"])
    d.add("parameters",
          [{"object_id": oid(i), "parameter_id": place, "name": "@" + a, "is_output": m == "OUT",
            "user_type_id": type_ids[seed.TYPES[t]["mssql"][0]]}
           for i, _, _, _, args, _ in seed.ROUTINES for place, (a, m, t) in enumerate(args, start=1)][::-1],
          NATIVE["mssql"]["parameters"])
    d.add("sequences", _sequence_rows(big=False), _SEQUENCE_FIELDS,
          object_id=F.col("i") + 9000, schema_id=F.lit(5), name=F.col("sname"), minimum_value=F.col("lo"),
          maximum_value=F.col("hi"), increment=F.col("step"), current_value=F.col("last"),
          is_cycling=F.col("cyclic") & (F.col("i") == 42))
    triggers = [
        {"object_id": oid(i), "parent_id": oid(t), "name": n, "is_insert": "INSERT" in events, "is_update": "UPDATE" in events,
         "is_delete": "DELETE" in events, "is_after": timing == "AFTER", "is_instead_of": timing != "AFTER",
         "is_disabled": not on, "is_ms_shipped": False}
        for i, n, t, timing, events, _, on, _ in seed.TRIGGERS
    ]
    triggers.append({**triggers[0], "object_id": oid(59), "name": "shipped", "is_ms_shipped": True})  # left out
    d.add("triggers", triggers, NATIVE["mssql"]["triggers"], where="has_triggers")
    # One target with schema, one with database and schema, one bare.
    target = F.concat(F.lit("["), F.col("tname"), F.lit("]"))
    schema = F.concat(F.lit("["), F.col("main_owner"), F.lit("]."))
    database = F.concat(F.lit("["), F.col("database_name"), F.lit("]."))
    d.add("synonyms", [{"object_id": oid(i), "schema_id": 5, "name": n, "tname": NAMES[t]} for i, n, t, _ in seed.SYNONYMS],
          "object_id long, schema_id int, name string, tname string", where="has_synonyms",
          base_object_name=F.when(F.col("name") == "GAUGE", F.concat(schema, target))
          .when(F.col("name") == "WATER", F.concat(database, schema, target)).otherwise(target))
    return d.frames()


BUILDERS = {"postgresql": postgresql, "mysql": mysql, "oracle": oracle, "mssql": mssql}


def fleet(customer: DataFrame) -> dict[str, Frames]:
    """Native dumps of all dialects."""
    return {dialect: build(customer) for dialect, build in BUILDERS.items()}


def registry(customer: DataFrame) -> DataFrame:
    """Dialect names as users wrote them, one per customer."""
    raw = F.lit(None).cast("string")
    for segment, name in seed.RAW_DIALECTS.items():
        raw = F.when(F.col("c_mktsegment") == segment, F.lit(name)).otherwise(raw)
    return customer.select(F.col("c_custkey").alias("source_id"), raw.alias("raw"))

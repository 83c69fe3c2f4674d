"""The catalog of a gauging service that every database of the fleet holds, in logical form.

Invented for this fleet. It puts the hard cases into every source: a composite foreign key whose columns stand in another order,
a name under two owners, a column in two unique indexes, a trigger on several events, a trigger on a view, a sequence beyond
64 bits, markup and quotes in comments, names outside ASCII.
"""

MAIN, ARCHIVE, SYSTEM = "main", "archive", "system"

# number, name, owner role, rows (None: not known), comment, created, modified
TABLES = [
    (1, "Messstelle", MAIN, 84, "Pegel an Flüssen und Seen", "2019-04-02 08:15:00", "2023-11-30 17:45:10"),
    (2, "Gewässer", MAIN, 31, "Flüsse, Seen, Kanäle", "2019-04-02 08:00:00", "2021-02-17 06:05:59"),
    (3, "Ablesung", MAIN, 9120, "Abgelesene Wasserstände", "2019-05-20 12:00:00", "2024-03-01 00:00:01"),
    (4, "Revier", MAIN, 6, "Revier <Nord & Süd>", None, None),
    (5, "Dienst", MAIN, 77, "", None, None),
    (6, "Gewässer", ARCHIVE, None, "Stand der alten Kartierung", "1998-07-01 00:00:00", None),
    (7, "Einstellung", SYSTEM, 3, "", None, None),
]
VIEW = (8, "Pegelübersicht", MAIN, "Mittlerer Wasserstand je Messstelle")

# Type texts and (length, precision, scale) per dialect.
TYPES = {
    "num4": {"postgresql": ("numeric(4,0)", 0, 0, 0), "mysql": ("decimal", 0, 4, 0), "oracle": ("NUMBER", 0, 4, 0), "mssql": ("decimal", 5, 4, 0)},
    "num6": {"postgresql": ("numeric(6,0)", 0, 0, 0), "mysql": ("decimal", 0, 6, 0), "oracle": ("NUMBER", 0, 6, 0), "mssql": ("decimal", 5, 6, 0)},
    "num10": {"postgresql": ("numeric(10,0)", 0, 0, 0), "mysql": ("decimal", 0, 10, 0), "oracle": ("NUMBER", 0, 10, 0), "mssql": ("decimal", 9, 10, 0)},
    "money": {"postgresql": ("numeric(10,2)", 0, 0, 0), "mysql": ("decimal", 0, 10, 2), "oracle": ("NUMBER", 0, 10, 2), "mssql": ("numeric", 9, 10, 2)},
    "number": {"postgresql": ("numeric", 0, 0, 0), "mysql": ("bigint", 0, 19, 0), "oracle": ("NUMBER", 0, 0, 0), "mssql": ("bigint", 8, 19, 0)},
    "text10": {"postgresql": ("character varying(10)", 0, 0, 0), "mysql": ("varchar", 10, 0, 0), "oracle": ("VARCHAR2", 10, 0, 0), "mssql": ("nvarchar", 20, 0, 0)},
    "text50": {"postgresql": ("character varying(50)", 0, 0, 0), "mysql": ("varchar", 50, 0, 0), "oracle": ("VARCHAR2", 50, 0, 0), "mssql": ("nvarchar", 100, 0, 0)},
    "text100": {"postgresql": ("character varying(100)", 0, 0, 0), "mysql": ("varchar", 100, 0, 0), "oracle": ("VARCHAR2", 100, 0, 0), "mssql": ("nvarchar", 200, 0, 0)},
    "text200": {"postgresql": ("character varying(200)", 0, 0, 0), "mysql": ("varchar", 200, 0, 0), "oracle": ("VARCHAR2", 200, 0, 0), "mssql": ("nvarchar", 400, 0, 0)},
    "date": {"postgresql": ("date", 0, 0, 0), "mysql": ("date", 0, 0, 0), "oracle": ("DATE", 0, 0, 0), "mssql": ("date", 3, 10, 0)},
}

# table number, position, name, type, nullable, comment
COLUMNS = [
    (1, 1, "Nummer", "num6", False, "Nummer im Pegelverzeichnis"),
    (1, 2, "Gewässernummer", "num4", True, "woran die Messstelle liegt"),
    (1, 3, "Bezeichnung", "text50", False, "Name auf der Karte"),
    (1, 4, "Kilometer", "money", True, "Weg von der Mündung"),
    (1, 5, "Betriebsart", "text10", True, "von Hand oder selbsttätig"),
    (1, 6, "Kennung", "text100", True, "Kennung im Funknetz"),
    (1, 7, "Eröffnet", "date", True, "erster Tag der Reihe"),
    (2, 1, "Gewässernummer", "num4", False, "amtliche Nummer"),
    (2, 2, "Name", "text50", False, "amtlicher Name"),
    (2, 3, "Mündung", "num4", True, "Nummer des Gewässers, in das es fließt"),
    (3, 1, "Laufnummer", "num10", False, "fortlaufend"),
    (3, 2, "Stelle", "num6", False, "wo abgelesen wurde"),
    (3, 3, "Tag", "date", False, "wann abgelesen wurde"),
    (3, 4, "Wasserstand", "money", True, "in Zentimetern über dem Nullpunkt"),
    (3, 5, "Bemerkung", "text200", True, "Eis, Treibgut, Ausfall"),
    (4, 1, "Bezirk", "num4", False, "erster Teil des Schlüssels"),
    (4, 2, "Abschnitt", "num4", False, "zweiter Teil des Schlüssels"),
    (4, 3, "Titel", "text50", True, "der \"Rufname\""),
    (5, 1, "Dienstnummer", "num10", False, "Nummer des Dienstes"),
    (5, 2, "Dienstabschnitt", "num4", False, "Abschnitt des Reviers"),
    (5, 3, "Dienstbezirk", "num4", False, "Bezirk des Reviers"),
    (5, 4, "Ausweis", "text10", True, "Nummer des Ausweises"),
    (6, 1, "Gewässernummer", "num4", False, "alte Nummer"),
    (6, 2, "Name", "text50", True, ""),
    (7, 1, "Wert", "text50", True, ""),
    (8, 1, "Nummer", "num6", True, "Nummer der Messstelle"),
    (8, 2, "Bezeichnung", "text50", True, "Name der Messstelle"),
    (8, 3, "Ablesungen", "number", True, "wie viele es gibt"),
    (8, 4, "Mittel", "number", True, "mittlerer Wasserstand"),
]
RENAMED = (3, 5, "Text")  # the column and its forbidden name, in some sources

# Default texts as the server reports them; Oracle keeps trailing blanks, which are trimmed.
DEFAULTS = {
    (1, 5): {"postgresql": "'HAND'::character varying", "mysql": "HAND", "oracle": "'HAND'", "mssql": "('HAND')"},
    (3, 1): {"postgresql": "nextval('Ablesung_Zähler'::regclass)", "mysql": None, "oracle": "Ablesung_Zähler.NEXTVAL", "mssql": None},
}
AUTO_INCREMENT = (3, 1)  # by default in PostgreSQL, by property in MySQL and SQL Server, unknown in Oracle

# number, table number, name, column positions, unique, primary, comment
INDEXES = [
    (11, 1, "PK_Messstelle", [1], True, True, "Schlüssel der Messstellen"),
    (12, 1, "IX_Messstelle_Lage", [2, 4], False, False, "Stellen eines Gewässers der Reihe nach"),
    (13, 1, "UQ_Messstelle_Kennung", [6], True, False, ""),
    (14, 2, "PK_Gewässer", [1], True, True, "Schlüssel der Gewässer"),
    (15, 3, "PK_Ablesung", [1], True, True, ""),
    (16, 3, "IX_Ablesung_Reihe", [2, 3], False, False, "Reihe einer Stelle"),
    (17, 4, "PK_Revier", [1, 2], True, True, ""),
    (18, 5, "PK_Dienst", [1], True, True, ""),
    (19, 5, "UQ_Dienst_Ausweis", [4], True, False, ""),
    (20, 5, "UQ_Dienst_Bezirk", [4, 3], True, False, ""),
    (21, 6, "PK_Gewässer", [1], True, True, ""),
    (22, 6, "IX_Gewässer_Name", [2], False, False, ""),
]
# name, child table, child positions, parent table, parent positions
FOREIGN_KEYS = [
    ("FK_Messstelle_Gewässer", 1, [2], 2, [1]),
    ("FK_Ablesung_Stelle", 3, [2], 1, [1]),
    ("FK_Dienst_Revier", 5, [2, 3], 4, [2, 1]),
]

# number, name, type, comment, arguments (name, mode, type), return type
ROUTINES = [
    (31, "Ablesung_nachtragen", "PROCEDURE", "schließt eine Lücke der Reihe", [("p_stelle", "IN", "number"), ("p_tag", "IN", "date")], ""),
    (32, "Höchststand", "FUNCTION", "der höchste Wasserstand einer Stelle", [("p_stelle", "IN", "number")], "text50"),
]
# name, min, max, increment, last, cache, comment
SEQUENCES = [
    (41, "Ablesung_Zähler", 1, 500000000, 1, 9120, 50, "Laufnummern der Ablesungen"),
    (42, "Messstelle_Zähler", 200000, 899999, 5, 200420, 25, "Nummern neuer Messstellen"),
    (43, "BIG_SEQ", 1, 9999999999999999999999999999, 1, 1, 0, ""),
]
# number, name, table number, timing, events, level, enabled, comment
TRIGGERS = [
    (51, "TR_Ablesung_Grenzen", 3, "BEFORE", ["INSERT"], "ROW", True, "weist unmögliche Wasserstände ab"),
    (52, "TR_Messstelle_Spur", 1, "AFTER", ["UPDATE"], "ROW", True, "hält Änderungen fest"),
    (53, "TR_Gewässer_Prüfung", 2, "AFTER", ["INSERT", "UPDATE", "DELETE"], "STATEMENT", False, ""),
    (54, "TR_Übersicht_Ersatz", 8, "INSTEAD OF", ["INSERT"], "ROW", True, ""),
]
# number, name, target table number, comment
SYNONYMS = [
    (61, "GAUGE", 1, "englischer Name der Messstellen"),
    (62, "WATER", 2, "englischer Name der Gewässer"),
    (63, "READING", 3, ""),
]

VERSIONS = {
    "postgresql": ["PostgreSQL 16.2"],
    "mysql": ["8.0.36"],
    "oracle": ["21c Standard Edition", "PL/SQL Release 19.0.0.0.0"],
    "mssql": ["Microsoft SQL Server 2022"],
}
DIALECT_CODES = {"postgresql": 0, "mysql": 1, "oracle": 2, "mssql": 3}
SYSTEM_OWNER = {"postgresql": "pg_catalog", "mysql": "mysql", "oracle": "SYS", "mssql": "sys"}
EXTRACTED_AT = "2025-01-31T09:00:00Z"

# How sources differ, by the customer that owns the database:
#   owner of the main objects  PEGEL when c_nationkey < 20, else PEGEL2
#   row counts                 plus c_custkey
#   column comments            blank when (c_custkey + position) mod 3 = 0
#   triggers                   none when c_mktsegment = BUILDING
#   synonyms                   none when c_acctbal < 0
#   column Bemerkung             named Text when c_mktsegment = MACHINERY
#   view                       updatable when c_mktsegment = HOUSEHOLD
#   second sequence            cyclic when c_mktsegment = FURNITURE
NO_TRIGGERS, RENAMES, UPDATABLE, CYCLIC = "BUILDING", "MACHINERY", "HOUSEHOLD", "FURNITURE"
# Dialect names as users write them, by market segment.
RAW_DIALECTS = {
    "AUTOMOBILE": " Postgres ", "BUILDING": "PG", "FURNITURE": "SQLServer", "HOUSEHOLD": "Oracle ", "MACHINERY": "SQLite",
}

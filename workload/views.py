"""The library's tables, derived from the test tables.

Each view is one SELECT that Spark and DuckDB both accept. ``{name}`` stands for a test table
or for another view. Nothing is left out of a test table: where a request batch or an older
snapshot is needed, it follows from the values of the rows.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, SparkSession

from rosterlab.plans.durable import freeze
from rosterlab.session import sized_by_input

# Declared types of the test tables, so that reading one starts no job to look at its files.
TABLES = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double,"
    " c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int,"
    " p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int,"
    " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
    " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double,"
    " props string",
    "pages": "page_id long, url string, html string",
}

DEFAULT_PATH = "assets/vehicle_placeholder.svg"
GAME_MODES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")
CATEGORY_LABELS = {"ECONOMY": "Basic", "PROMO": "Special offer", "LARGE": "Heavy"}
NATION_LABELS = {"NATION_0": "Northland", "NATION_7": "Zeeland", "NATION_24": "Aland"}

VIEWS = {
    "nations": """
        SELECT n_nationkey AS nation_id, n_name AS name,
               CONCAT('flags/', CAST(n_nationkey AS STRING), '.png') AS flag_path
        FROM {nation}""",
    "categories": """
        SELECT DISTINCT p_type AS category_id, p_type AS name,
               CONCAT('class ', p_type) AS description
        FROM {part}""",
    "units": f"""
        SELECT p_partkey AS unit_id, CAST(p_partkey % 25 AS INT) AS nation_id,
               p_type AS category_id, p_name AS name, CAST(p_size % 8 + 1 AS INT) AS tier,
               p_retailprice AS rating, p_size AS cost,
               CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN '{DEFAULT_PATH}'
                    ELSE CONCAT('media/', p_brand, '.png') END AS media_path
        FROM {{part}}""",
    # Search words: pieces of the names of every twentieth unit, with wildcards in all places.
    "keywords": """
        SELECT DISTINCT CASE CAST(FLOOR(unit_id / 20) AS BIGINT) % 8
                 WHEN 0 THEN SUBSTR(name, 3, 5) WHEN 1 THEN CONCAT(SUBSTR(name, 1, 2), '%', SUBSTR(name, 6, 3))
                 WHEN 2 THEN CONCAT('_', SUBSTR(name, 4, 3), '_') WHEN 3 THEN SUBSTR(name, 2, 2)
                 WHEN 4 THEN UPPER(SUBSTR(name, 3, 6)) WHEN 5 THEN '%_%'
                 WHEN 6 THEN CONCAT(SUBSTR(name, 1, 3), '_', SUBSTR(name, 5, 4))
                 ELSE CONCAT('zz', SUBSTR(name, 1, 4)) END AS keyword
        FROM {units} WHERE unit_id % 20 = 0""",
    "rosters": """
        SELECT o_orderkey AS roster_id, c_nationkey AS nation_id,
               CONCAT('roster-', CAST(o_orderkey AS STRING)) AS title,
               o_orderpriority AS game_mode, o_totalprice AS target_rating,
               o_orderdate AS created_at
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "slots": """
        SELECT l_orderkey AS roster_id, l_partkey AS unit_id, l_linenumber AS slot_no,
               l_returnflag AS role_note
        FROM {lineitem}""",
    "slot_clean": """
        SELECT roster_id, slot_no, MAX(unit_id) AS unit_id,
               CHR(MAX(ASCII(role_note))) AS role_note
        FROM {slots} GROUP BY roster_id, slot_no""",
    # The slots that the placement rules allow: unit and roster of one nation.
    "own_slots": """
        SELECT s.roster_id, s.slot_no, s.unit_id, s.role_note
        FROM {slot_clean} s
        JOIN {units} u ON s.unit_id = u.unit_id
        JOIN {rosters} r ON s.roster_id = r.roster_id AND u.nation_id = r.nation_id""",
    "specs": """
        SELECT p_partkey AS unit_id, CAST(p_size * 10 AS INT) AS front,
               CAST(p_partkey % 40 AS INT) AS side, CAST(p_partkey % 30 AS INT) AS rear
        FROM {part} WHERE p_size <= 45""",
    "first_suppliers": """
        SELECT l_partkey AS part_id, MIN(l_suppkey) AS first_supplier
        FROM {lineitem} GROUP BY l_partkey""",
    "munitions": """
        SELECT l_partkey * 10000000 + l_suppkey AS munition_id, l_partkey AS unit_id,
               CONCAT('M-', CAST(l_suppkey AS STRING)) AS name,
               CONCAT('K', CAST(l_suppkey % 7 AS STRING)) AS kind, CAST(MAX(l_quantity) AS INT) AS pen,
               l_suppkey = first_supplier AS is_representative
        FROM {lineitem} JOIN {first_suppliers} ON l_partkey = part_id
        GROUP BY l_partkey, l_suppkey, first_supplier""",
    "pairs": "SELECT DISTINCT roster_id, unit_id FROM {slots}",
    "own_units": """
        SELECT roster_id AS own_roster, MIN(unit_id) AS own_unit
        FROM {own_slots} GROUP BY roster_id""",
    "slot_changes": """
        SELECT event_id AS change_id, ts AS change_ts,
               CASE WHEN event_id % 97 = 0 THEN -1 ELSE user_id END AS roster_id,
               CAST(event_id % 12 AS INT) AS slot_no,
               CASE WHEN event_type = 'error'
                        THEN CASE WHEN event_id % 5 = 0 THEN -1 ELSE event_id % 200 END
                    WHEN event_type = 'purchase'
                        THEN COALESCE(own_unit, (event_id % 7) * 25 + nation_id)
                    ELSE (event_id % 7) * 25 + nation_id END AS unit_id
        FROM {events} JOIN {rosters} ON user_id = roster_id
        LEFT JOIN {own_units} ON user_id = own_roster""",
    # The same log with removals between the placements.
    "mixed_changes": """
        SELECT change_id, change_ts, roster_id, slot_no, unit_id,
               CASE WHEN change_id % 9 = 4 THEN 'remove_slot' WHEN change_id % 9 = 7 THEN 'remove_unit'
                    WHEN change_id % 101 = 5 THEN 'swap' ELSE 'place' END AS kind
        FROM {slot_changes}""",
    # Requests to delete: every error event names a unit by its own number. At any scale about
    # four in five name a unit that does not exist.
    "delete_requests": """
        SELECT event_id AS request_id, event_id AS unit_id
        FROM {events} WHERE event_type = 'error'""",
    # Stored units with some that no slot holds: an extra one for every event beyond the parts.
    "extra_units": """
        SELECT event_id AS unit_id, CAST(event_id % 25 AS INT) AS nation_id, event_type, props
        FROM {events} WHERE event_id > (SELECT MAX(p_partkey) FROM {part})""",
    "stock": """
        SELECT * FROM {units}
        UNION ALL
        SELECT unit_id, nation_id, 'LARGE', CONCAT('extra ', CAST(unit_id AS STRING)), 1, 2.0, 3,
               event_type
        FROM {extra_units}""",
    "stock_specs": """
        SELECT * FROM {specs} UNION ALL SELECT unit_id, 1, 2, 3 FROM {extra_units}""",
    "stock_munitions": """
        SELECT * FROM {munitions}
        UNION ALL
        SELECT -unit_id, unit_id, event_type, props, 5, unit_id % 2 = 0 FROM {extra_units}""",
    "removals": """
        SELECT user_id AS roster_id, CAST(event_id % 12 AS INT) AS slot_no,
               (event_id % 7) * 25 + event_id % 25 AS unit_id
        FROM {events}""",
    "selections": """
        SELECT event_id AS selection_id, user_id AS roster_id,
               CAST(event_id % 25 AS INT) AS nation_id
        FROM {events}""",
    # Registrations: all stored units once more in capitals, then one new unit per event. The
    # events repeat names in different case and break each rule now and then.
    "registrations": """
        SELECT -1 - p_partkey AS request_id, CAST(p_partkey % 25 AS INT) AS nation_id,
               p_type AS category_id, UPPER(p_name) AS name, 1 AS tier, p_retailprice AS rating,
               p_size AS cost, CAST(NULL AS STRING) AS media_path, 1 AS front, 1 AS side,
               1 AS rear, 'again' AS munition_name, CAST(NULL AS STRING) AS munition_kind,
               1 AS pen
        FROM {part}
        UNION ALL
        SELECT event_id, CAST(user_id % 27 AS INT),
               CASE event_type WHEN 'signup' THEN 'STANDARD' WHEN 'view' THEN 'LARGE'
                    WHEN 'click' THEN 'SMALL' WHEN 'purchase' THEN 'PROMO' ELSE 'UNKNOWN' END,
               CASE WHEN event_id % 31 = 0 THEN '   '
                    WHEN event_id % 2 = 0
                        THEN CONCAT(' NEW ', CAST(user_id AS STRING), '-',
                                    CAST(event_id % 40 AS STRING), ' ')
                    ELSE CONCAT('new ', CAST(user_id AS STRING), '-',
                                CAST(event_id % 41 AS STRING)) END,
               CAST(event_id % 10 AS INT), value,
               CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 53 AS INT) - 1 END,
               CASE WHEN event_id % 3 = 0 THEN CONCAT('media/', event_type, '.png') END,
               CAST(event_id % 61 AS INT) - 1, CAST(event_id % 40 AS INT),
               CAST(event_id % 30 AS INT),
               CASE WHEN event_id % 37 = 0 THEN NULL ELSE CONCAT('m-', event_type) END,
               CASE WHEN event_id % 2 = 0 THEN event_type END,
               CAST(REGEXP_EXTRACT(props, '([0-9]+)', 1) AS INT) - 1
        FROM {events}""",
    "roster_requests": """
        SELECT event_id AS request_id, CAST(user_id % 27 AS INT) AS nation_id,
               CASE event_type WHEN 'error' THEN ' ' ELSE
                    CONCAT('  ', event_type, ' ', CAST(user_id AS STRING), ' ') END AS title,
               CASE event_type WHEN 'view' THEN '1-URGENT' WHEN 'click' THEN '2-HIGH'
                    WHEN 'signup' THEN 'OTHER' ELSE '3-MEDIUM' END AS game_mode,
               value AS target_rating
        FROM {events}""",
    "raw_forms": """
        SELECT event_id,
               CASE event_type WHEN 'error' THEN '  ' ELSE CONCAT(' ', event_type) END AS name,
               CAST(user_id AS STRING) AS nation_id,
               CASE event_type WHEN 'click' THEN props WHEN 'view' THEN NULL
                    ELSE REGEXP_EXTRACT(props, '([0-9]+)', 1) END AS tier,
               CASE event_type WHEN 'signup' THEN '' WHEN 'purchase' THEN '1.5.2'
                    ELSE CAST(value AS STRING) END AS rating,
               CASE event_type WHEN 'view' THEN '7.5' WHEN 'click' THEN ' 7 '
                    ELSE CONCAT('-', CAST(user_id AS STRING)) END AS cost
        FROM {events}""",
    "media_paths": """
        SELECT p_name AS name, MIN(CONCAT('media/new/', p_brand, '.png')) AS path
        FROM {part} WHERE p_type = 'PROMO' AND p_size < 10 GROUP BY p_name""",
    "media_manifest": f"""
        SELECT DISTINCT CASE p_type WHEN 'SMALL' THEN CONCAT('media/', p_brand, '.png')
               WHEN 'LARGE' THEN CONCAT('assets/media/', p_brand, '.png')
               ELSE '{DEFAULT_PATH}' END AS path
        FROM {{part}} WHERE p_size < 20""",
    "media_refs": f"""
        SELECT unit_id, media_path FROM {{units}}
        UNION ALL SELECT -1 - page_id, url FROM {{pages}}""",
    "page_refs": """
        SELECT page_id AS ref_id, url AS path FROM {pages}
        UNION ALL SELECT -1 - unit_id, media_path FROM {units}""",
    # Owners: suppliers are stored; customers and renumbered suppliers are provided.
    "owners": """
        SELECT s_suppkey AS owner_id, s_name AS name, 'stored' AS note FROM {supplier}""",
    # Nations and categories of an older store, and a provider that has all of them with new texts
    # and under second ids.
    "old_nations": "SELECT * FROM {nations} WHERE nation_id % 5 <> 0",
    "provided_nations": """
        SELECT nation_id, name, CONCAT('new/', flag_path) AS flag_path, CAST(nation_id AS BIGINT) AS position
        FROM {nations}
        UNION ALL
        SELECT CAST(100 + nation_id AS INT), name, 'twin', CAST(1000 + nation_id AS BIGINT) FROM {nations}""",
    "old_categories": "SELECT * FROM {categories} WHERE category_id NOT IN ('PROMO', 'LARGE')",
    "provided_categories": """
        SELECT category_id, name, CONCAT('new ', description) AS description, 1 AS position FROM {categories}
        UNION ALL
        SELECT CONCAT('twin ', category_id), name, 'twin', 2 FROM {categories}""",
    "provided_owners": """
        SELECT c_custkey AS owner_id, c_name AS name, 'customer' AS note, c_custkey AS position
        FROM {customer}
        UNION ALL
        SELECT 1000000000000 + s_suppkey, s_name, 'moved', 1000000000000 + s_suppkey
        FROM {supplier}
        UNION ALL
        SELECT 2000000000000 + c_custkey % 1000, CONCAT('twin ', c_mktsegment),
               'twin', 2000000000000 + c_custkey
        FROM {customer}""",
    # First load: every part as a provider's wide row; the columns are those of the staged schema.
    "wide_units": """
        SELECT p_partkey AS unit_id, CAST(p_partkey % 25 AS INT) AS nation_id,
               CASE p_type WHEN 'STANDARD' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LARGE' THEN 3
                    WHEN 'ECONOMY' THEN 4 WHEN 'PROMO' THEN 5 ELSE 6 END AS category_id,
               CONCAT(p_name, ' #', CAST(p_partkey AS STRING)) AS name,
               CAST(p_size % 8 + 1 AS INT) AS tier, p_retailprice AS rating, p_size AS cost,
               CASE WHEN p_size % 3 = 0 THEN CONCAT('media/', p_brand, '.png') END AS media_path,
               p_size AS front, p_size + 1 AS side, p_size + 2 AS rear,
               CONCAT('shot ', p_brand) AS munition_name,
               CASE WHEN p_size % 2 = 0 THEN p_type END AS munition_kind, p_size * 3 AS pen
        FROM {part}""",
    # Reference sync: the stored catalogue holds the units of size 35 and below; the provider
    # has all of them with other paths, larger units that are new, and repeats of one brand.
    "old_units": """
        SELECT unit_id, nation_id, category_id,
               CONCAT(name, ' #', CAST(unit_id AS STRING)) AS name, tier, rating, cost, media_path
        FROM {units} WHERE cost <= 35""",
    "old_specs": """
        SELECT unit_id, front, side, rear FROM {specs} JOIN {part} ON unit_id = p_partkey
        WHERE p_size <= 35""",
    "old_munitions": """
        SELECT munition_id, unit_id, name, kind, pen, is_representative AND p_size >= 10
               AS is_representative
        FROM {munitions} JOIN {part} ON unit_id = p_partkey
        WHERE p_size BETWEEN 5 AND 35""",
    "provided_units": f"""
        SELECT p_partkey AS position,
               CASE WHEN p_size > 45 THEN p_partkey - p_size
                    WHEN p_size > 40 THEN p_partkey + 1000000000 - p_partkey % 3
                    ELSE p_partkey END AS preferred_id,
               CAST(p_partkey % 25 AS INT) AS nation_id, p_type AS category_id,
               CONCAT(p_name, ' #', CAST(p_partkey AS STRING)) AS name,
               CAST(p_size % 8 + 1 AS INT) AS tier, p_retailprice AS rating, p_size AS cost,
               CASE WHEN p_brand = 'Brand#1' THEN '{DEFAULT_PATH}'
                    ELSE CONCAT('media/sync/', p_brand, '.png') END AS media_path,
               p_size AS front, p_size AS side, p_size AS rear,
               CONCAT('shot ', p_brand) AS munition_name, p_type AS munition_kind, p_size AS pen
        FROM {{part}}
        UNION ALL
        SELECT 1000000000000 + p_partkey, p_partkey, CAST(p_partkey % 25 AS INT), 'LARGE',
               CONCAT(p_name, ' #', CAST(p_partkey AS STRING)), 8, 9.5, 99,
               CONCAT('media/late/', p_type, '.png'), 9, 9, 9, 'late', 'late', 9
        FROM {{part}} WHERE p_brand IN ('Brand#1', 'Brand#2')""",
    # The same with rows that break the rules: registrations, some without a name, and rows for
    # stored units whose values count only where a spec or a munition is missing.
    "faulty_units": """
        SELECT * FROM {provided_units}
        UNION ALL
        SELECT 3000000000000 + request_id, request_id, nation_id, category_id,
               CASE WHEN request_id % 29 = 0 THEN NULL ELSE name END, tier, rating, cost, media_path,
               front, side, rear, munition_name, munition_kind, pen
        FROM {registrations}
        UNION ALL
        SELECT 4000000000000 + p_partkey, p_partkey, CAST(p_partkey % 25 AS INT), 'NONE',
               CONCAT(p_name, ' #', CAST(p_partkey AS STRING)), 99, -3.0, -1, NULL,
               CASE WHEN p_size % 2 = 0 THEN -1 ELSE 1 END, 1, 1, 'shot', NULL,
               CASE WHEN p_size % 3 = 0 THEN -1 WHEN p_size % 3 = 1 THEN NULL ELSE 1 END
        FROM {part}""",
}


def _needs(template: str) -> list[str]:
    return list(dict.fromkeys(field for _, field, _, _ in Formatter().parse(template) if field))


class Inputs:
    """Test tables and views of one scale-factor folder as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir.rstrip("/"), {}
        sized_by_input(spark, sum(self._bytes(name) for name in TABLES))

    def _bytes(self, table: str) -> int:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.sf_dir}/{table}.parquet")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return files.getContentSummary(path).getLength() if files.exists(path) else 0

    def store(self, name: str) -> DataFrame:
        """A view that several others and steps need, worked out once: what is made from now on reads its rows."""
        self._made[name] = freeze(getattr(self, name))
        return self._made[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.schema(TABLES[name]).parquet(
                    f"{self.sf_dir}/{name}.parquet"
                )
            else:
                template = VIEWS[name]
                parts = {need: getattr(self, need) for need in _needs(template)}
                self._made[name] = self.spark.sql(template, **parts)
        return self._made[name]


def _order(name: str, seen: dict[str, None]) -> None:
    for need in _needs(VIEWS[name]):
        if need in VIEWS and need not in seen:
            _order(need, seen)
    seen[name] = None


def duckdb_sql(body: str) -> str:
    """SQL text in which ``{name}`` refers to test tables and views, as one statement."""
    wanted: dict[str, None] = {}
    for need in _needs(body):
        if need in VIEWS and need not in wanted:
            _order(need, wanted)
    names = {table: table for table in TABLES} | {view: f"v_{view}" for view in VIEWS}
    parts = [f"v_{view} AS ({VIEWS[view].format(**names).strip()})" for view in wanted]
    text = body.format(**names).strip()
    if not parts:
        return text
    recursive = ""
    if text.upper().startswith("WITH RECURSIVE "):
        recursive, text = "RECURSIVE ", text[len("WITH RECURSIVE "):]
    elif text.upper().startswith("WITH "):
        text = text[len("WITH "):]
    else:
        return "WITH " + ",\n".join(parts) + "\n" + text
    return f"WITH {recursive}" + ",\n".join(parts) + ",\n" + text

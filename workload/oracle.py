"""The registered queries as plain SQL over the same views, for DuckDB."""

from __future__ import annotations

from workload.queries import CREATED_AT, MEDIA_HOST
from workload.views import CATEGORY_LABELS, DEFAULT_PATH, GAME_MODES, NATION_LABELS, duckdb_sql


def _label(column: str, labels: dict[str, str]) -> str:
    arms = " ".join(f"WHEN '{old}' THEN '{new}'" for old, new in labels.items())
    return f"CASE {column} {arms} ELSE {column} END"


NATION = _label("n.name", NATION_LABELS)
CATEGORY = _label("c.name", CATEGORY_LABELS)
MODES = ", ".join(f"'{mode}'" for mode in GAME_MODES)

LISTED = f"""
    SELECT u.unit_id, u.name, {NATION} AS nation, {CATEGORY} AS category, u.tier, u.rating, u.cost,
           u.media_path
    FROM {{units}} u JOIN {{nations}} n ON u.nation_id = n.nation_id
    JOIN {{categories}} c ON u.category_id = c.category_id"""

DETAIL = f"""
    SELECT r.roster_id, r.title, {NATION} AS nation, r.game_mode, s.slot_no, u.unit_id,
           u.name AS unit_name, {CATEGORY} AS category, u.tier, u.rating, u.cost, s.role_note
    FROM {{rosters}} r JOIN {{nations}} n ON r.nation_id = n.nation_id
    JOIN {{slot_clean}} s ON r.roster_id = s.roster_id
    JOIN {{units}} u ON s.unit_id = u.unit_id
    JOIN {{categories}} c ON u.category_id = c.category_id
    WHERE u.nation_id = r.nation_id"""

SUMMARY = f"""
    SELECT r.roster_id, r.title, {NATION} AS nation, COUNT(u.unit_id) AS unit_count,
           ROUND(AVG(u.rating), 1) AS average_rating, MAX(u.rating) AS cap_same_nation,
           CAST(SUM(u.cost) AS BIGINT) AS total_cost
    FROM {{rosters}} r JOIN {{nations}} n ON r.nation_id = n.nation_id
    LEFT JOIN {{slot_clean}} s ON r.roster_id = s.roster_id
    LEFT JOIN {{units}} u ON s.unit_id = u.unit_id AND u.nation_id = r.nation_id
    GROUP BY r.roster_id, r.title, {NATION}"""

CAP = """
    SELECT s.roster_id, MAX(u.rating) AS cap_all
    FROM {slots} s JOIN {units} u ON s.unit_id = u.unit_id GROUP BY s.roster_id"""


def _benchmark(shots: str) -> str:
    """CTEs up to ``wide``: a plain BETWEEN join from distinct caps to peers."""
    return f"""
    cap AS ({CAP}),
    peer AS (
        SELECT u.rating, m.pen, s.front, s.side, s.rear
        FROM {{units}} u JOIN {{specs}} s ON u.unit_id = s.unit_id
        JOIN {{munitions}} m ON u.unit_id = m.unit_id AND m.is_representative),
    band AS (
        SELECT d.cap_all, COUNT(p.rating) AS peer_count, AVG(p.pen) AS avg_pen,
               AVG(p.front) AS avg_front, AVG(p.side) AS avg_side, AVG(p.rear) AS avg_rear
        FROM (SELECT DISTINCT cap_all FROM cap) d
        LEFT JOIN peer p
          ON p.rating BETWEEN d.cap_all - CAST(1.0 AS DOUBLE) AND d.cap_all + CAST(1.0 AS DOUBLE)
        GROUP BY d.cap_all),
    shot AS ({shots}),
    wide AS (
        SELECT p.roster_id, p.unit_id, k.cap_all, k.cap_all - CAST(1.0 AS DOUBLE) AS band_low,
               k.cap_all + CAST(1.0 AS DOUBLE) AS band_high,
               CASE WHEN k.cap_all IS NULL THEN '-'
                    ELSE format('{{{{:.1f}}}} ~ {{{{:.1f}}}}', k.cap_all - CAST(1.0 AS DOUBLE),
                                k.cap_all + CAST(1.0 AS DOUBLE)) END AS band_label, u.name AS unit_name, u.rating,
               m.munition_id, m.name AS munition_name, m.kind AS munition_kind, m.pen,
               s.front, s.side, s.rear, COALESCE(b.peer_count, 0) AS peer_count,
               b.avg_pen, b.avg_front, b.avg_side, b.avg_rear
        FROM {{pairs}} p JOIN {{units}} u ON p.unit_id = u.unit_id
        JOIN {{specs}} s ON u.unit_id = s.unit_id
        JOIN shot m ON u.unit_id = m.unit_id
        LEFT JOIN cap k ON p.roster_id = k.roster_id
        LEFT JOIN band b ON k.cap_all = b.cap_all)"""


ALL_SHOTS = "SELECT * FROM {munitions} WHERE is_representative"
FIRST_SHOT = """
    SELECT * FROM {munitions} WHERE is_representative
    QUALIFY ROW_NUMBER() OVER (PARTITION BY unit_id ORDER BY munition_id) = 1"""

METRIC_ROWS = " UNION ALL ".join(
    f"SELECT '{label}' AS metric, '{family}' AS metric_family, CAST({m} AS DOUBLE) AS selected,"
    f" COALESCE(avg_{m}, 0) AS average, 'mm' AS measure, wide.* FROM wide"
    for m, label, family in (
        ("pen", "관통력", "penetration"),
        ("front", "정면 장갑", "armor"),
        ("side", "측면 장갑", "armor"),
        ("rear", "후면 장갑", "armor"),
    )
)

LONG = f"""
    WITH {_benchmark(FIRST_SHOT)},
    metric AS ({METRIC_ROWS}),
    gap AS (
        SELECT *, CASE WHEN average = 0 THEN 0 ELSE (selected - average) / average * 100 END AS g
        FROM metric)
    SELECT roster_id, unit_id, metric, metric_family, ROUND(selected, 1) AS selected,
           ROUND(average, 1) AS average, ROUND(g, 1) AS gap_pct,
           CASE WHEN g >= 35 THEN '매우 높음' WHEN g >= 15 THEN '높음' WHEN g >= 5 THEN '약간 높음'
                WHEN g <= -35 THEN '매우 낮음' WHEN g <= -15 THEN '낮음'
                WHEN g <= -5 THEN '약간 낮음' ELSE '비슷함' END AS verdict,
           measure, cap_all, band_label, peer_count, unit_name, rating, munition_name, munition_kind
    FROM gap"""


def _unique(select: str) -> str:
    rules = (
        ("nation", "nations", ("nation_id",)),
        ("nation", "nations", ("name",)),
        ("category", "categories", ("category_id",)),
        ("category", "categories", ("name",)),
        ("unit", "units", ("unit_id",)),
        ("unit", "units", ("nation_id", "name")),
        ("spec", "specs", ("unit_id",)),
        ("munition", "munitions", ("munition_id",)),
        ("roster", "rosters", ("roster_id",)),
        ("slot", "slots", ("roster_id", "slot_no")),
        ("slot", "slots", ("roster_id", "unit_id")),
    )
    return " UNION ALL ".join(
        select.format(
            table=table,
            rule=",".join(columns),
            text=" || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in columns),
            groups=f"SELECT {', '.join(columns)}, COUNT(*) AS row_count FROM {{{view}}}"
            f" GROUP BY {', '.join(columns)} HAVING COUNT(*) > 1",
        )
        for table, view, columns in rules
    )


def _not_null() -> str:
    tables = {
        "nation": ("nations", ("nation_id", "name")),
        "category": ("categories", ("category_id", "name")),
        "unit": (
            "registrations",
            ("nation_id", "category_id", "name", "tier", "rating", "cost", "munition_name"),
        ),
        "spec": ("specs", ("unit_id", "front", "side", "rear")),
        "munition": ("munitions", ("munition_id", "unit_id", "name", "pen", "is_representative")),
        "roster": (
            "rosters",
            ("roster_id", "nation_id", "title", "game_mode", "target_rating", "created_at"),
        ),
        "slot": ("slots", ("roster_id", "unit_id", "slot_no")),
    }
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{c}' AS rule,"
        f" COUNT(*) FILTER ({c} IS NULL) AS violations FROM {{{view}}}"
        for table, (view, columns) in tables.items()
        for c in columns
    )


def _checks() -> str:
    rules = (
        ("unit", "registrations", "tier_range", "tier < 1 OR tier > 8"),
        ("unit", "registrations", "rating_low", "rating < 1"),
        ("unit", "registrations", "cost_negative", "cost < 0"),
        ("spec", "registrations", "front_negative", "front < 0"),
        ("spec", "registrations", "side_negative", "side < 0"),
        ("spec", "registrations", "rear_negative", "rear < 0"),
        ("munition", "registrations", "pen_negative", "pen < 0"),
        ("roster", "rosters", "mode_unknown", f"game_mode NOT IN ({MODES})"),
        ("roster", "rosters", "target_low", "target_rating < 1"),
        ("slot", "slot_changes", "slot_range", "slot_no < 1 OR slot_no > 10"),
    )
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{rule}' AS rule,"
        f" COUNT(*) FILTER ({broken}) AS violations FROM {{{view}}}"
        for table, view, rule, broken in rules
    )


def _references() -> str:
    new_units = "(SELECT request_id AS unit_id FROM {registrations})"
    rules = (
        ("unit", "{registrations}", "nation_id", "{nations}", "nation_id"),
        ("unit", "{registrations}", "category_id", "{categories}", "category_id"),
        ("spec", "{delete_requests}", "unit_id", new_units, "unit_id"),
        ("munition", "{munitions}", "unit_id", new_units, "unit_id"),
        ("roster", "{rosters}", "nation_id", "{nations}", "nation_id"),
        ("slot", "{slot_changes}", "roster_id", "{rosters}", "roster_id"),
        ("slot", "{slot_changes}", "unit_id", new_units, "unit_id"),
    )
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{column}' AS rule,"
        f" COUNT(DISTINCT x.{column}) AS violations, COUNT(*) AS rows_involved"
        f" FROM {child} x WHERE x.{column} IS NOT NULL AND NOT EXISTS"
        f" (SELECT 1 FROM {parent} p WHERE p.{key} = x.{column})"
        for table, child, column, parent, key in rules
    )


JUDGED = """
    staged AS (
        SELECT b.* REPLACE (TRIM(name) AS name, COALESCE(cost, 0) AS cost,
                            COALESCE(media_path, '') AS media_path,
                            COALESCE(munition_kind, '') AS munition_kind),
               CASE WHEN name IS NULL OR TRIM(name) = '' THEN 'name_missing'
                    WHEN munition_name IS NULL THEN 'value_missing' END AS unfilled,
               CASE WHEN tier < 1 OR tier > 8 THEN 'tier_range' WHEN rating < 1 THEN 'rating_low'
                    WHEN COALESCE(cost, 0) < 0 THEN 'cost_negative'
                    WHEN front < 0 OR side < 0 OR rear < 0 THEN 'armor_negative'
                    WHEN pen < 0 THEN 'pen_negative'
                    WHEN nation_id NOT IN (SELECT nation_id FROM {nations}) THEN 'nation_missing'
                    WHEN category_id NOT IN (SELECT category_id FROM {categories})
                        THEN 'category_missing' END AS fault
        FROM {registrations} b),
    first_valid AS (
        SELECT nation_id, LOWER(name) AS k, MIN(request_id) AS first_id FROM staged
        WHERE unfilled IS NULL AND fault IS NULL GROUP BY 1, 2),
    judged AS (
        SELECT s.*, CASE WHEN unfilled IS NOT NULL THEN unfilled
                         WHEN EXISTS (SELECT 1 FROM {units} u WHERE u.nation_id = s.nation_id
                                      AND LOWER(u.name) = LOWER(s.name)) THEN 'name_taken'
                         WHEN s.request_id > f.first_id THEN 'name_taken_in_batch'
                         ELSE fault END AS reason
        FROM staged s LEFT JOIN first_valid f
          ON s.nation_id = f.nation_id AND LOWER(s.name) = f.k),
    accepted AS (
        SELECT request_id, nation_id, category_id, name, tier, rating, cost, media_path, front, side,
               rear, munition_name, munition_kind, pen,
               (SELECT MAX(unit_id) FROM {units}) + ROW_NUMBER() OVER (ORDER BY request_id)
                   AS unit_id,
               (SELECT MAX(munition_id) FROM {munitions})
                   + ROW_NUMBER() OVER (ORDER BY request_id) AS munition_id
        FROM judged WHERE reason IS NULL)"""

GONE = """
    used AS (SELECT DISTINCT unit_id FROM {slots}),
    gone AS (SELECT unit_id FROM {delete_requests}
             WHERE unit_id NOT IN (SELECT unit_id FROM used))"""

NEW_ROSTERS = f"""
    judged AS (
        SELECT request_id, nation_id, TRIM(title) AS title, game_mode, target_rating,
               CASE WHEN TRIM(title) = '' THEN 'title_blank'
                    WHEN nation_id NOT IN (SELECT nation_id FROM {{nations}}) THEN 'nation_missing'
                    WHEN game_mode NOT IN ({MODES}) THEN 'mode_unknown'
                    WHEN target_rating < 1 THEN 'target_low' END AS reason
        FROM {{roster_requests}})"""

STATIC = """
    static AS (
        SELECT c.*, CASE WHEN r.roster_id IS NULL THEN 'roster_missing'
                         WHEN u.unit_id IS NULL THEN 'unit_missing'
                         WHEN r.nation_id <> u.nation_id THEN 'nation_mismatch'
                         WHEN c.slot_no < 1 OR c.slot_no > 10 THEN 'slot_range' END AS reason
        FROM {slot_changes} c LEFT JOIN {rosters} r ON c.roster_id = r.roster_id
        LEFT JOIN {units} u ON c.unit_id = u.unit_id)"""

HELD = ", ".join(f"MAX(CASE WHEN slot_no = {n} THEN unit_id END)" for n in range(1, 11))

# Step by step over each roster's changes; the state is the list of its ten slots.
WALK = f"""
    WITH RECURSIVE {STATIC},
    movable AS (
        SELECT roster_id, change_id, slot_no, unit_id,
               ROW_NUMBER() OVER (PARTITION BY roster_id ORDER BY change_ts, change_id) AS n
        FROM static WHERE reason IS NULL),
    begin AS (
        SELECT m.roster_id, [{HELD}] AS held
        FROM (SELECT DISTINCT roster_id FROM movable) m
        LEFT JOIN {{slot_clean}} s ON m.roster_id = s.roster_id GROUP BY m.roster_id),
    walk AS (
        SELECT roster_id, CAST(0 AS BIGINT) AS n, held, CAST(NULL AS BIGINT) AS change_id,
               CAST(NULL AS VARCHAR) AS verdict, CAST(NULL AS INTEGER) AS slot_no
        FROM begin
        UNION ALL
        SELECT w.roster_id, m.n,
               CASE WHEN list_contains(w.held, m.unit_id)
                         AND w.held[m.slot_no] IS DISTINCT FROM m.unit_id THEN w.held
                    ELSE list_transform(w.held,
                         lambda x, i: CASE WHEN i = m.slot_no THEN m.unit_id ELSE x END) END,
               m.change_id,
               CASE WHEN list_contains(w.held, m.unit_id)
                         AND w.held[m.slot_no] IS DISTINCT FROM m.unit_id THEN 'already_placed'
                    WHEN w.held[m.slot_no] IS NOT NULL THEN 'replace' ELSE 'add' END,
               m.slot_no
        FROM walk w JOIN movable m ON m.roster_id = w.roster_id AND m.n = w.n + 1)"""

# The same walk with removals, of a slot or of a unit wherever it is.
MIXED_STATIC = STATIC.replace("{slot_changes}", "{mixed_changes}").replace(
    "CASE WHEN",
    "CASE WHEN kind NOT IN ('place', 'remove_slot', 'remove_unit') THEN 'kind_unknown'"
    " WHEN kind <> 'place' THEN NULL WHEN",
    1,
)
MIXED_WALK = f"""
    WITH RECURSIVE {MIXED_STATIC},
    movable AS (
        SELECT roster_id, change_id, slot_no, unit_id, kind,
               ROW_NUMBER() OVER (PARTITION BY roster_id ORDER BY change_ts, change_id) AS n
        FROM static WHERE reason IS NULL),
    begin AS (
        SELECT m.roster_id, [{HELD}] AS held
        FROM (SELECT DISTINCT roster_id FROM movable) m
        LEFT JOIN {{slot_clean}} s ON m.roster_id = s.roster_id GROUP BY m.roster_id),
    walk AS (
        SELECT roster_id, CAST(0 AS BIGINT) AS n, held, CAST(NULL AS BIGINT) AS change_id,
               CAST(NULL AS VARCHAR) AS verdict, CAST(NULL AS INTEGER) AS slot_no
        FROM begin
        UNION ALL
        SELECT w.roster_id, m.n,
               CASE WHEN m.kind = 'remove_unit' THEN list_transform(w.held,
                         lambda x: CASE WHEN x = m.unit_id THEN NULL ELSE x END)
                    WHEN m.kind = 'remove_slot' THEN list_transform(w.held,
                         lambda x, i: CASE WHEN i = m.slot_no THEN NULL ELSE x END)
                    WHEN list_contains(w.held, m.unit_id)
                         AND w.held[m.slot_no] IS DISTINCT FROM m.unit_id THEN w.held
                    ELSE list_transform(w.held,
                         lambda x, i: CASE WHEN i = m.slot_no THEN m.unit_id ELSE x END) END,
               m.change_id,
               CASE WHEN m.kind <> 'place' THEN 'remove'
                    WHEN list_contains(w.held, m.unit_id)
                         AND w.held[m.slot_no] IS DISTINCT FROM m.unit_id THEN 'already_placed'
                    WHEN w.held[m.slot_no] IS NOT NULL THEN 'replace' ELSE 'add' END,
               m.slot_no
        FROM walk w JOIN movable m ON m.roster_id = w.roster_id AND m.n = w.n + 1)"""

WALKED_SLOTS = f"""{WALK},
    final AS (
        SELECT roster_id, held FROM walk
        QUALIFY ROW_NUMBER() OVER (PARTITION BY roster_id ORDER BY n DESC) = 1),
    cells AS (
        SELECT roster_id, CAST(i AS INTEGER) AS slot_no, held[i] AS unit_id
        FROM final, range(1, 11) AS g(i)),
    touched AS (SELECT DISTINCT roster_id, slot_no FROM walk WHERE verdict IN ('add', 'replace'))
    SELECT c.roster_id, c.unit_id, c.slot_no,
           CASE WHEN t.roster_id IS NULL THEN s.role_note ELSE '' END AS role_note
    FROM cells c LEFT JOIN touched t ON c.roster_id = t.roster_id AND c.slot_no = t.slot_no
    LEFT JOIN {{slot_clean}} s ON c.roster_id = s.roster_id AND c.slot_no = s.slot_no
    WHERE c.unit_id IS NOT NULL
    UNION ALL
    SELECT roster_id, unit_id, slot_no, role_note FROM {{slot_clean}}
    WHERE roster_id NOT IN (SELECT roster_id FROM final)"""

MIXED_SLOTS = WALKED_SLOTS.replace(WALK, MIXED_WALK)

UNSET = "({0} IS NULL OR TRIM({0}) = '' OR {0} = '" + DEFAULT_PATH + "')"

OWNER_NEW = """
    first_rows AS (
        SELECT * FROM {provided_owners}
        QUALIFY ROW_NUMBER() OVER (PARTITION BY owner_id ORDER BY position) = 1),
    fresh AS (SELECT * FROM first_rows WHERE owner_id NOT IN (SELECT owner_id FROM {owners})),
    judged AS (
        SELECT *, name IN (SELECT name FROM {owners})
                  OR ROW_NUMBER() OVER (PARTITION BY name ORDER BY position) > 1 AS taken
        FROM fresh)"""

SYNC = f"""
    offer AS (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY nation_id, name ORDER BY position) AS rn,
               FIRST_VALUE(media_path) OVER (PARTITION BY nation_id, name
                   ORDER BY {UNSET.format("media_path")}, position) AS set_path,
               BOOL_AND({UNSET.format("media_path")}) OVER (PARTITION BY nation_id, name) AS none_set,
               LAST_VALUE(media_path) OVER (PARTITION BY nation_id, name ORDER BY position
                   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_path
        FROM {{provided_units}}),
    one AS (
        SELECT *, CASE WHEN none_set THEN last_path ELSE set_path END AS offered_path
        FROM offer WHERE rn = 1),
    stored AS (SELECT nation_id, name, MIN(unit_id) AS unit_id FROM {{old_units}} GROUP BY 1, 2),
    fresh AS (
        SELECT o.*, o.preferred_id NOT IN (SELECT unit_id FROM {{old_units}})
                    AND ROW_NUMBER() OVER (PARTITION BY o.preferred_id ORDER BY o.position) = 1
                    AS granted
        FROM one o WHERE NOT EXISTS (
            SELECT 1 FROM stored s WHERE s.nation_id = o.nation_id AND s.name = o.name)),
    top AS (
        SELECT GREATEST((SELECT MAX(unit_id) FROM {{old_units}}),
                        (SELECT MAX(preferred_id) FROM fresh WHERE granted)) AS n),
    added AS (
        SELECT *, CASE WHEN granted THEN preferred_id
                       ELSE (SELECT n FROM top)
                            + ROW_NUMBER() OVER (PARTITION BY granted ORDER BY position)
                  END AS unit_id
        FROM fresh),
    offered AS (
        SELECT s.unit_id, o.position, o.front, o.side, o.rear, o.munition_name, o.munition_kind, o.pen
        FROM one o JOIN stored s ON s.nation_id = o.nation_id AND s.name = o.name
        UNION ALL
        SELECT unit_id, position, front, side, rear, munition_name, munition_kind, pen FROM added)"""

SYNCED = f"""
    SELECT u.* REPLACE (CASE WHEN o.name IS NOT NULL AND {UNSET.format('u.media_path')}
                             THEN o.offered_path ELSE u.media_path END AS media_path)
    FROM {{old_units}} u LEFT JOIN one o ON u.nation_id = o.nation_id AND u.name = o.name
    UNION ALL
    SELECT unit_id, nation_id, category_id, name, tier, rating, cost, offered_path FROM added"""

TEXT = "TRIM({0}, ' \t\r\n')"


def _int(column: str) -> str:
    text = TEXT.format(column)
    return f"CASE WHEN regexp_matches({text}, '^[+-]?[0-9]+$') THEN TRY_CAST({text} AS INTEGER) END"


def _float(column: str) -> str:
    text = TEXT.format(column)
    return (
        f"CASE WHEN regexp_matches({text}, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$')"
        f" THEN TRY_CAST({text} AS DOUBLE) END"
    )


def _fault(column: str, parsed: str) -> str:
    return (
        f"CASE WHEN {column} IS NULL OR {TEXT.format(column)} = '' THEN '{column}:required'"
        f" WHEN {parsed} IS NULL THEN '{column}:malformed' END"
    )


INTAKE = f"""
    SELECT event_id, {TEXT.format('name')} AS name, {_int('nation_id')} AS nation_id,
           {_int('tier')} AS tier, {_float('rating')} AS rating, {_int('cost')} AS cost,
           CONCAT_WS(',', {_fault('name', 'name')}, {_fault('nation_id', _int('nation_id'))},
                     {_fault('tier', _int('tier'))}, {_fault('rating', _float('rating'))},
                     {_fault('cost', _int('cost'))}) AS reasons
    FROM {{raw_forms}}"""

REMOTE = (
    "(LOWER({0}) LIKE 'http://%' OR LOWER({0}) LIKE 'https://%' OR LOWER({0}) LIKE 'data:image%')"
)

SOURCES = {
    "nation_list": f"SELECT nation_id, {NATION} AS name, flag_path FROM {{nations}} n",
    "category_list": f"SELECT category_id, {CATEGORY} AS name, description FROM {{categories}} c",
    "label_normalise": f"""
        SELECT unit_id, {_label('category_id', CATEGORY_LABELS)} AS category_id FROM {{units}}""",
    "picklist": """
        SELECT 0 AS position, '' AS key, 'all' AS label
        UNION ALL SELECT 1, CAST(roster_id AS VARCHAR), title FROM {rosters}""",
    "unit_search": f"""{LISTED}
        WHERE u.nation_id = 7 AND u.category_id = 'PROMO' AND u.rating >= 901.5
          AND u.rating <= 990.5 AND LOWER(u.name) LIKE '%l%_n%'""",
    "unit_search_all": LISTED,
    "unit_search_indexed": f"""
        SELECT k.keyword, s.* FROM {{keywords}} k
        JOIN ({LISTED}) s ON LOWER(s.name) LIKE CONCAT('%', LOWER(k.keyword), '%')""",
    "unit_detail": f"""
        SELECT u.*, {NATION} AS nation, {CATEGORY} AS category, s.front, s.side, s.rear,
               m.name AS munition_name, m.kind AS munition_kind, m.pen
        FROM {{units}} u JOIN {{nations}} n ON u.nation_id = n.nation_id
        JOIN {{categories}} c ON u.category_id = c.category_id
        LEFT JOIN {{specs}} s ON u.unit_id = s.unit_id
        LEFT JOIN {{munitions}} m ON u.unit_id = m.unit_id AND m.is_representative""",
    "unit_munitions": "SELECT * FROM {munitions}",
    "dashboard_summary": """
        SELECT (SELECT COUNT(*) FROM {units} u JOIN {nations} n ON u.nation_id = n.nation_id
                JOIN {categories} c ON u.category_id = c.category_id) AS unit_count,
               (SELECT COUNT(*) FROM {rosters} r JOIN {nations} n ON r.nation_id = n.nation_id)
                   AS roster_count,
               (SELECT COUNT(*) FROM {nations}) AS nation_count,
               COALESCE((SELECT title FROM {rosters} ORDER BY created_at DESC, roster_id DESC
                         LIMIT 1), '-') AS newest_title""",
    "roster_list": f"""
        SELECT r.*, {NATION} AS nation FROM {{rosters}} r
        JOIN {{nations}} n ON r.nation_id = n.nation_id""",
    "roster_list_of_nation": f"""
        SELECT r.*, {NATION} AS nation FROM {{rosters}} r
        JOIN {{nations}} n ON r.nation_id = n.nation_id WHERE r.nation_id = 7""",
    "latest_roster_per_nation": """
        SELECT nation_id, roster_id, title, created_at FROM {rosters}
        QUALIFY ROW_NUMBER() OVER (
            PARTITION BY nation_id ORDER BY created_at DESC, roster_id DESC) = 1""",
    "roster_slots": "SELECT * FROM {slots}",
    "roster_detail": DETAIL,
    "roster_summary": SUMMARY,
    "roster_cap_list": f"""
        SELECT roster_id, COALESCE(CAST(cap_same_nation AS VARCHAR), '-') AS cap_text
        FROM ({SUMMARY})""",
    "roster_cards": f"""
        SELECT roster_id, COALESCE(CAST(cap_same_nation AS VARCHAR), '-') AS cap_text,
               COALESCE(CAST(average_rating AS VARCHAR), '-') AS average_text,
               COALESCE(total_cost, 0) AS total_cost, unit_count
        FROM ({SUMMARY})""",
    "roster_cap": CAP,
    "category_counts": f"""
        SELECT roster_id, category, COUNT(*) AS unit_count FROM ({DETAIL})
        GROUP BY roster_id, category""",
    "slot_grid": f"""
        SELECT r.roster_id, CAST(i AS INTEGER) AS slot_no, d.unit_id, d.unit_name, d.category,
               d.rating
        FROM {{rosters}} r CROSS JOIN range(1, 11) AS g(i)
        LEFT JOIN ({DETAIL}) d ON r.roster_id = d.roster_id AND i = d.slot_no""",
    "slot_occupancy": """
        SELECT r.roster_id, CAST(i AS INTEGER) AS slot_no, s.roster_id IS NOT NULL AS is_taken
        FROM {rosters} r CROSS JOIN range(1, 11) AS g(i)
        LEFT JOIN (SELECT DISTINCT roster_id, slot_no FROM {slots}) s
          ON r.roster_id = s.roster_id AND i = s.slot_no""",
    "available_units": f"""
        WITH newest AS (
            SELECT nation_id, roster_id FROM {{rosters}}
            QUALIFY ROW_NUMBER() OVER (
                PARTITION BY nation_id ORDER BY created_at DESC, roster_id DESC) = 1)
        SELECT w.roster_id, u.unit_id, u.name, {CATEGORY} AS category, u.rating
        FROM newest w JOIN {{units}} u ON w.nation_id = u.nation_id
        JOIN {{nations}} n ON u.nation_id = n.nation_id
        JOIN {{categories}} c ON u.category_id = c.category_id
        WHERE NOT EXISTS (SELECT 1 FROM {{slots}} s
                          WHERE s.roster_id = w.roster_id AND s.unit_id = u.unit_id)""",
    "available_counts": """
        WITH listed AS (
            SELECT u.unit_id, u.nation_id FROM {units} u
            WHERE u.nation_id IN (SELECT nation_id FROM {nations})
              AND u.category_id IN (SELECT category_id FROM {categories}))
        SELECT r.roster_id, (SELECT COUNT(*) FROM listed u WHERE u.nation_id = r.nation_id)
               - COUNT(DISTINCT u.unit_id) AS available_count
        FROM {rosters} r LEFT JOIN {slots} h ON r.roster_id = h.roster_id
        LEFT JOIN listed u ON u.unit_id = h.unit_id AND u.nation_id = r.nation_id
        GROUP BY r.roster_id, r.nation_id""",
    "units_in_use": """
        SELECT unit_id, name FROM {stock} WHERE unit_id IN (SELECT unit_id FROM {slots})""",
    "stale_selection": """
        SELECT * FROM {selections} x WHERE NOT EXISTS (
            SELECT 1 FROM {rosters} r
            WHERE r.roster_id = x.roster_id AND r.nation_id = x.nation_id)""",
    "peer_benchmark": f"WITH {_benchmark(ALL_SHOTS)} SELECT * FROM wide",
    "peer_benchmark_long": LONG,
    "assign_ids": """
        SELECT o_orderkey, (SELECT MAX(unit_id) FROM {units})
               + ROW_NUMBER() OVER (ORDER BY o_orderkey) AS new_id FROM {orders}""",
    "media_enrich": f"""
        SELECT u.unit_id, u.name, COALESCE('{MEDIA_HOST}' || p.path, '{DEFAULT_PATH}') AS media_path
        FROM {{units}} u LEFT JOIN {{media_paths}} p ON u.name = p.name""",
    "media_backfill": f"""
        SELECT u.* REPLACE (CASE WHEN {UNSET.format('u.media_path')}
                                 THEN COALESCE(p.path, '{DEFAULT_PATH}')
                                 ELSE u.media_path END AS media_path)
        FROM {{units}} u LEFT JOIN {{media_paths}} p ON u.name = p.name""",
    "media_kind": f"""
        SELECT ref_id, path, CASE WHEN path IS NULL OR TRIM(path) = '' THEN 'none'
               WHEN {REMOTE.format('path')} THEN 'remote' ELSE 'file' END AS media_kind
        FROM {{page_refs}}""",
    "media_resolve": f"""
        WITH raw AS (
            SELECT unit_id, TRIM(COALESCE(media_path, '')) AS p FROM {{media_refs}})
        SELECT unit_id, CASE
            WHEN {REMOTE.format('p')} THEN p
            WHEN p <> '' AND p IN (SELECT path FROM {{media_manifest}}) THEN p
            WHEN p <> '' AND NOT starts_with(p, '/')
                 AND 'assets/' || p IN (SELECT path FROM {{media_manifest}}) THEN 'assets/' || p
            WHEN '{DEFAULT_PATH}' IN (SELECT path FROM {{media_manifest}}) THEN '{DEFAULT_PATH}'
            END AS resolved
        FROM raw""",
    "audit_unique": _unique(
        "SELECT '{table}' AS table_name, '{rule}' AS rule, COUNT(*) AS violations,"
        " CAST(COALESCE(SUM(row_count), 0) AS BIGINT) AS rows_involved FROM ({groups})"
    ),
    "audit_unique_keys": _unique(
        "SELECT '{table}' AS table_name, '{rule}' AS rule, {text} AS key_value, row_count"
        " FROM ({groups})"
    ),
    "audit_not_null": _not_null(),
    "audit_check": _checks(),
    "audit_fk": _references(),
    "intake_validate": INTAKE,
    "register_units_accepted": f"WITH {JUDGED} SELECT * FROM accepted",
    "register_units_rejected": f"""
        WITH {JUDGED}
        SELECT request_id, nation_id, name, reason FROM judged WHERE reason IS NOT NULL""",
    "register_units_tables": f"""
        WITH {JUDGED}
        SELECT u.*, s.front, s.side, s.rear, m.munition_id, m.name AS munition_name, m.pen
        FROM {{units}} u LEFT JOIN {{specs}} s ON u.unit_id = s.unit_id
        LEFT JOIN {{munitions}} m ON u.unit_id = m.unit_id AND m.is_representative
        UNION ALL
        SELECT unit_id, nation_id, category_id, name, tier, rating, cost, media_path, front, side,
               rear, munition_id, munition_name, pen
        FROM accepted""",
    "delete_units_remaining": f"""
        WITH {GONE} SELECT unit_id, name FROM {{stock}}
        WHERE unit_id NOT IN (SELECT unit_id FROM gone)""",
    "delete_units_specs": f"""
        WITH {GONE} SELECT * FROM {{stock_specs}} WHERE unit_id NOT IN (SELECT unit_id FROM gone)""",
    "delete_units_munitions": f"""
        WITH {GONE} SELECT * FROM {{stock_munitions}} WHERE unit_id NOT IN (SELECT unit_id FROM gone)""",
    "delete_units_rejected": f"""
        WITH {GONE} SELECT DISTINCT unit_id, 'in_use' AS reason FROM {{delete_requests}}
        WHERE unit_id IN (SELECT unit_id FROM used)""",
    "create_rosters": f"""
        WITH {NEW_ROSTERS}
        SELECT (SELECT MAX(roster_id) FROM {{rosters}}) + ROW_NUMBER() OVER (ORDER BY request_id)
                   AS roster_id,
               nation_id, title, game_mode, target_rating,
               CAST('{CREATED_AT}' AS TIMESTAMP) AS created_at
        FROM judged WHERE reason IS NULL""",
    "create_rosters_rejected": f"""
        WITH {NEW_ROSTERS} SELECT request_id, reason FROM judged WHERE reason IS NOT NULL""",
    "slot_change_verdicts": f"""
        WITH {STATIC}
        SELECT c.change_id, c.roster_id, c.slot_no, c.unit_id,
               CASE WHEN reason IS NOT NULL THEN reason
                    WHEN h.unit_id IS DISTINCT FROM c.unit_id AND EXISTS (
                        SELECT 1 FROM {{slot_clean}} o
                        WHERE o.roster_id = c.roster_id AND o.unit_id = c.unit_id)
                        THEN 'already_placed'
                    WHEN h.unit_id IS NOT NULL THEN 'replace' ELSE 'add' END AS verdict
        FROM static c LEFT JOIN {{slot_clean}} h
          ON c.roster_id = h.roster_id AND c.slot_no = h.slot_no""",
    "slot_change_verdicts_repeats": f"""
        WITH {STATIC}
        SELECT c.change_id, c.roster_id, c.slot_no, c.unit_id,
               CASE WHEN reason IS NOT NULL THEN reason
                    WHEN (c.roster_id, c.unit_id) IN (SELECT (roster_id, unit_id) FROM {{slots}})
                         AND (c.roster_id, c.unit_id, c.slot_no)
                             NOT IN (SELECT (roster_id, unit_id, slot_no) FROM {{slots}})
                        THEN 'already_placed'
                    WHEN (c.roster_id, c.slot_no) IN (SELECT (roster_id, slot_no) FROM {{slots}})
                        THEN 'replace' ELSE 'add' END AS verdict
        FROM static c""",
    "apply_slot_changes": WALKED_SLOTS,
    "apply_slot_changes_log": f"""{WALK}
        SELECT change_id, roster_id, slot_no, unit_id, reason AS verdict FROM static
        WHERE reason IS NOT NULL
        UNION ALL
        SELECT w.change_id, w.roster_id, w.slot_no, m.unit_id, w.verdict
        FROM walk w JOIN movable m ON w.change_id = m.change_id""",
    "apply_mixed_changes": MIXED_SLOTS,
    "apply_mixed_changes_log": f"""{MIXED_WALK}
        SELECT change_id, roster_id, slot_no, unit_id, kind, reason AS verdict FROM static
        WHERE reason IS NOT NULL
        UNION ALL
        SELECT w.change_id, w.roster_id, w.slot_no, m.unit_id, m.kind, w.verdict
        FROM walk w JOIN movable m ON w.change_id = m.change_id""",
    "slot_feed": WALKED_SLOTS,
    "slot_feed_mixed": MIXED_SLOTS,
    "slot_feed_mixed_log": f"""{MIXED_WALK}
        SELECT change_id, roster_id, slot_no, unit_id, kind, reason AS verdict FROM static
        WHERE reason IS NOT NULL
        UNION ALL
        SELECT w.change_id, w.roster_id, w.slot_no, m.unit_id, m.kind, w.verdict
        FROM walk w JOIN movable m ON w.change_id = m.change_id""",
    # The average of decimals, as the figures are kept.
    "live_roster_summary": SUMMARY.replace(
        "AVG(u.rating)", "CAST(SUM(CAST(u.rating AS DECIMAL(24, 10))) AS DOUBLE) / COUNT(u.rating)"
    ).replace("{slot_clean}", f"({MIXED_SLOTS})"),
    "live_category_counts": f"""
        SELECT roster_id, category, COUNT(*) AS unit_count
        FROM ({DETAIL.replace("{slot_clean}", f"({MIXED_SLOTS})")}) GROUP BY roster_id, category""",
    "remove_slots_by_unit": """
        SELECT * FROM {slots} s WHERE NOT EXISTS (
            SELECT 1 FROM {removals} x
            WHERE x.roster_id = s.roster_id AND x.unit_id = s.unit_id)""",
    "remove_slots_by_number": """
        SELECT * FROM {slots} s WHERE NOT EXISTS (
            SELECT 1 FROM {removals} x
            WHERE x.roster_id = s.roster_id AND x.slot_no = s.slot_no)""",
    "sync_dims": f"""
        WITH {OWNER_NEW}
        SELECT owner_id, name, note FROM {{owners}}
        UNION ALL SELECT owner_id, name, note FROM judged WHERE NOT taken""",
    "sync_units_rejected": """
        WITH j AS (
            SELECT p.*, s.id IS NULL AS is_new,
                   s.id IS NULL OR s.id NOT IN (SELECT unit_id FROM {old_specs}) AS no_spec,
                   s.id IS NULL OR s.id NOT IN (
                       SELECT unit_id FROM {old_munitions} WHERE is_representative) AS no_shot
            FROM {faulty_units} p LEFT JOIN (
                SELECT nation_id, name, MIN(unit_id) AS id FROM {old_units}
                GROUP BY nation_id, name) s
              ON p.nation_id = s.nation_id AND p.name = s.name),
        named AS (
            SELECT position, nation_id, name, CASE
                WHEN name IS NULL THEN 'name_missing'
                WHEN nation_id IS NULL
                     OR is_new AND (category_id IS NULL OR tier IS NULL OR rating IS NULL
                                    OR cost IS NULL)
                     OR no_spec AND (front IS NULL OR side IS NULL OR rear IS NULL)
                     OR no_shot AND (munition_name IS NULL OR pen IS NULL) THEN 'value_missing'
                WHEN is_new AND tier NOT BETWEEN 1 AND 8 THEN 'tier_range'
                WHEN is_new AND rating < 1 THEN 'rating_low'
                WHEN is_new AND cost < 0 THEN 'cost_negative'
                WHEN no_spec AND LEAST(front, side, rear) < 0 THEN 'armor_negative'
                WHEN no_shot AND pen < 0 THEN 'pen_negative'
                WHEN is_new AND nation_id NOT IN (SELECT nation_id FROM {nations})
                    THEN 'nation_missing'
                WHEN is_new AND category_id NOT IN (SELECT category_id FROM {categories})
                    THEN 'category_missing' END AS reason
            FROM j)
        SELECT * FROM named WHERE reason IS NOT NULL""",
    "sync_dims_rejected": f"""
        WITH {OWNER_NEW}
        SELECT owner_id, name, 'name_taken' AS reason FROM judged WHERE taken""",
    "sync_units": f"WITH {SYNC} {SYNCED}",
    "refresh_units": f"""
        WITH {SYNC},
        synced AS ({SYNCED}),
        named AS (SELECT name, MAX(media_path) AS path FROM {{provided_units}} GROUP BY name)
        SELECT s.* REPLACE (CASE WHEN {UNSET.format('s.media_path')}
                                 THEN COALESCE(n.path, '{DEFAULT_PATH}')
                                 ELSE s.media_path END AS media_path)
        FROM synced s LEFT JOIN named n ON s.name = n.name""",
    "first_load_units": """
        SELECT unit_id, nation_id, category_id, name, tier, rating, cost, media_path
        FROM {wide_units}""",
    "first_load_specs": "SELECT unit_id, front, side, rear FROM {wide_units}",
    "first_load_munitions": """
        SELECT ROW_NUMBER() OVER (ORDER BY unit_id) AS munition_id, unit_id,
               munition_name AS name, munition_kind AS kind, pen, TRUE AS is_representative
        FROM {wide_units}""",
    "sync_units_specs": f"""
        WITH {SYNC}
        SELECT unit_id, front, side, rear FROM {{old_specs}}
        UNION ALL SELECT unit_id, front, side, rear FROM offered
        WHERE unit_id NOT IN (SELECT unit_id FROM {{old_specs}})""",
    "sync_units_munitions": f"""
        WITH {SYNC}
        SELECT munition_id, unit_id, name, kind, pen, is_representative FROM {{old_munitions}}
        UNION ALL
        SELECT (SELECT MAX(munition_id) FROM {{old_munitions}})
                   + ROW_NUMBER() OVER (ORDER BY position),
               unit_id, munition_name, munition_kind, pen, TRUE
        FROM offered WHERE unit_id NOT IN (
            SELECT unit_id FROM {{old_munitions}} WHERE is_representative)""",
}

# Syncs over ranges, and the whole reference load, give the tables of the plain sync.
for _name, _plain in {
    "sync_ranges_units": "sync_units",
    "sync_ranges_specs": "sync_units_specs",
    "sync_ranges_munitions": "sync_units_munitions",
    "refresh_specs": "sync_units_specs",
    "refresh_munitions": "sync_units_munitions",
    "available_set_counts": "available_counts",
    "audit_followed_unique": "audit_unique",
    "audit_followed_fk": "audit_fk",
    "audit_followed_checks": "audit_check",
    "register_feed": "register_units_accepted",
    "provider_load_nations": "nation_rows",
    "provider_load_units": "first_load_units",
    "provider_load_munitions": "first_load_munitions",
}.items():
    SOURCES[_name] = SOURCES.get(_plain, "SELECT nation_id, name, flag_path FROM {nations}")
SOURCES["available_bitmaps"] = f"SELECT roster_id, unit_id FROM ({SOURCES['available_units']})"
SOURCES["refresh_nations"] = """
        SELECT * FROM {old_nations}
        UNION ALL SELECT nation_id, name, CONCAT('new/', flag_path) FROM {nations}
        WHERE nation_id NOT IN (SELECT nation_id FROM {old_nations})"""
SOURCES["refresh_categories"] = """
        SELECT * FROM {old_categories}
        UNION ALL SELECT category_id, name, CONCAT('new ', description) FROM {categories}
        WHERE category_id NOT IN (SELECT category_id FROM {old_categories})"""


def statements() -> dict[str, str]:
    return {name: duckdb_sql(body) for name, body in SOURCES.items()}

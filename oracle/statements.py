"""One DuckDB statement per named query, over the same views.

Amounts are summed as decimals and shown as doubles, so that neither engine depends on row order.
"""

from __future__ import annotations

from floorledger.catalogue import AREA, BATCH, MANAGER, MONTH, YEAR
from floorledger.sources.raw_star import raw_text
from floorledger.sources.star import TABLES, VIEWS

PLAIN = {name: name for name in [*TABLES, *VIEWS]}
LEDGER_DAYS = {"play": "gaming_date", "comps": "gaming_date", "prizes": "gaming_date", "points": "op_date"}


def views_used(body: str) -> str:
    """A WITH list of the views, in dependency order."""
    texts = ", ".join(f"{name} AS ({text.format(**PLAIN)})" for name, text in VIEWS.items())
    return f"WITH {texts}" + (f", {body}" if body else "")


def money(column: str) -> str:
    return f"SUM(CAST({column} AS DECIMAL(18,2)))"


def dbl(expression: str) -> str:
    return f"CAST({expression} AS DOUBLE)"


def where_period(day: str, year: str = "", month: str = "") -> str:
    parts = []
    if year:
        parts.append(f"strftime({day}, '%Y') = '{year}'")
    if month:
        parts.append(f"strftime({day}, '%m') = '{month}'")
    return " AND ".join(parts) or "TRUE"


def cut(year: str = "", month: str = "", comps_filter: str = "TRUE") -> str:
    """The four ledgers cut to a period: p_play, p_points, p_comps, p_prizes, and v_comps (filtered)."""
    parts = [
        f"p_{name} AS (SELECT * FROM {name} WHERE {where_period(day, year, month)})"
        for name, day in LEDGER_DAYS.items()
    ]
    parts.append(f"v_comps AS (SELECT * FROM p_comps WHERE {comps_filter})")
    return ", ".join(parts)


def in_area(area: str) -> str:
    return f"user_id IN (SELECT user_id FROM managers WHERE area = '{area}')"


def by_manager(user: str) -> str:
    return f"user_id = '{user}'"


SLOT = f"""slot AS (
    SELECT player_id, MAX(full_name) AS full_name, MAX(player_level) AS player_level, COUNT(*) AS n,
           {money('coin_in')} AS coin, {money('promo_in')} AS promo, SUM(total_games) AS games,
           COUNT(DISTINCT gaming_date) AS days
    FROM p_play GROUP BY player_id)"""
TABLE = f"""tab AS (
    SELECT client_id, MAX(client_name) AS client_name, {money('coin_in_points')} AS coin,
           COUNT(DISTINCT op_date) AS days
    FROM p_points GROUP BY client_id)"""
PRIZE = f"""prize AS (
    SELECT client_id, COUNT(*) AS n, {money('amount')} AS amount FROM p_prizes GROUP BY client_id)"""
VOUCHER = f"""voucher AS (
    SELECT client_id, COUNT(*) AS n, {money('amount')} AS amount FROM v_comps GROUP BY client_id)"""
BOTH_DAYS = """both_days AS (
    SELECT client_id, COUNT(DISTINCT d) AS days FROM (
        SELECT player_id AS client_id, gaming_date AS d FROM p_play
        UNION SELECT client_id, op_date FROM p_points) GROUP BY client_id)"""
NAMED = """play_names AS (SELECT player_id, MAX(full_name) AS play_name FROM play GROUP BY player_id)"""
TOTAL_COIN = f"""total_coin AS (
    SELECT COALESCE((SELECT {money('coin_in')} FROM p_play), 0)
         + COALESCE((SELECT {money('coin_in_points')} FROM p_points), 0) AS coin)"""


def shown_name(name: str, play_name: str) -> str:
    return f"""CASE WHEN TRIM(COALESCE({name}, '')) <> '' THEN {name}
                    WHEN TRIM(COALESCE({play_name}, '')) <> '' THEN {play_name}
                    ELSE '(Sin registro en SRW)' END"""


def half_up4(value: str) -> str:
    """Four places; ties, also within 3e-16 relative, away from zero.  For values of 0 and above."""
    high = "(v * 134217729.0::DOUBLE - (v * 134217729.0::DOUBLE - v))"
    product = "(v * 1e4::DOUBLE)"
    error = f"(({high} * 1e4::DOUBLE - {product}) + (v - {high}) * 1e4::DOUBLE)"
    beyond = f"({product} - floor({product}) - 0.5::DOUBLE)"
    up = f"CASE WHEN ({beyond} + {error}) + {product} * 3e-16::DOUBLE >= 0 THEN 1 ELSE 0 END"
    return f"list_transform([{value}], lambda v: (floor({product}) + {up}) / 1e4::DOUBLE)[1]"


def half_even(value: str, places: int) -> str:
    """The exact binary value to some places; an exact tie (an odd multiple of 2**-(places+1)) to even."""
    halves = f"(v * {2 ** (places + 1)}.0::DOUBLE)"
    tie = f"{halves} = floor({halves}) AND floor({halves}) % 2 = 1"
    other = f"CAST(printf('%.{places}f', v) AS DOUBLE)"
    return f"list_transform([{value}], lambda v: CASE WHEN {tie} THEN ROUND_EVEN(v, {places}) ELSE {other} END)[1]"


def pct4(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN {half_up4(f'{part} * 100.0::DOUBLE / {whole}')} ELSE 0.0::DOUBLE END"


# ---- vouchers -------------------------------------------------------------------------------------


def comps_player(select: str, year: str = "", month: str = "") -> str:
    body = f"""{cut(year, month)}, {SLOT}, {TABLE}, {NAMED}, named AS (
        SELECT c.client_id, {shown_name('c.client_name', 'pn.play_name')} AS name, c.amount
        FROM p_comps c LEFT JOIN play_names pn ON pn.player_id = c.client_id),
      grp AS (SELECT client_id, name, COUNT(*) AS n, {dbl(money('amount'))} AS amount
              FROM named GROUP BY client_id, name),
      base AS (SELECT g.*, {dbl('COALESCE(s.coin, 0) + COALESCE(t.coin, 0)')} AS coin,
                      {dbl('COALESCE(s.promo, 0)')} AS promo, CAST(COALESCE(s.games, 0) AS BIGINT) AS games,
                      COALESCE(s.player_level, '-') AS player_level
               FROM grp g LEFT JOIN slot s ON s.player_id = g.client_id
                          LEFT JOIN tab t ON t.client_id = g.client_id)"""
    return f"{views_used(body)} {select}"


COMPS_BY_PLAYER = f"""SELECT client_id AS cliente_id, name AS nombre_cliente, n AS total_cortesias,
    amount AS monto_cortesias, coin AS total_coin_in, promo AS total_promo_in, games AS total_games,
    player_level, {pct4('amount', 'coin')} AS pct_cortesia_coin_in FROM base"""
EXPORT_COMPS = f"""SELECT client_id AS "ID", name AS "Nombre", n AS "Cortesias", amount AS "Monto_Cortesias",
    coin AS "Coin_In", player_level AS "Nivel", {pct4('amount', 'coin')} AS "Pct_Cortesia_CoinIn" FROM base"""


def over_comps(select: str, year: str = "", month: str = "") -> str:
    return f"{views_used(cut(year, month) + ', ' + TOTAL_COIN)} {select}"


COMPS_BY_CATEGORY = f"""
    , g AS (SELECT category, COUNT(*) AS n, {dbl(money('amount'))} AS amount FROM p_comps GROUP BY category)
    SELECT category AS descripcion_cat, n AS cantidad, amount AS monto_total,
           amount / (SELECT {dbl(money('amount'))} FROM p_comps) * 100.0::DOUBLE AS pct_total FROM g"""
PRODUCT_GROUPS = f"""
    , g AS (SELECT category, product, COUNT(*) AS n, {dbl(money('amount'))} AS amount
            FROM p_comps GROUP BY category, product)
    , c AS (SELECT category, {dbl(money('amount'))} AS amount FROM p_comps GROUP BY category)"""
COMPS_BY_PRODUCT = f"""{PRODUCT_GROUPS}
    SELECT g.category AS descripcion_cat, g.product AS descripcion_prod, g.n AS cantidad,
           g.amount AS monto_total, g.amount / c.amount * 100.0::DOUBLE AS pct_categoria
    FROM g JOIN c ON g.category IS NOT DISTINCT FROM c.category"""
COMPS_NESTED = f"""{PRODUCT_GROUPS}
    SELECT category AS descripcion_cat, product AS descripcion_prod, n AS cantidad, {dbl('amount')} AS monto_total
    FROM g"""
WEEKDAY = """CASE isodow(d) - 1 WHEN 0 THEN 'Lunes' WHEN 1 THEN 'Martes' WHEN 2 THEN 'Miércoles'
    WHEN 3 THEN 'Jueves' WHEN 4 THEN 'Viernes' WHEN 5 THEN 'Sábado' ELSE 'Domingo' END"""
COMPS_BY_DAY = f"""
    , c AS (SELECT gaming_date AS d, COUNT(*) AS n, {money('amount')} AS amount
            FROM p_comps WHERE gaming_date IS NOT NULL GROUP BY gaming_date)
    , s AS (SELECT gaming_date AS d, {money('coin_in')} AS coin FROM p_play GROUP BY gaming_date)
    , t AS (SELECT op_date AS d, {money('coin_in_points')} AS coin FROM p_points GROUP BY op_date)
    SELECT d AS fecha_jornada, n AS cantidad, {dbl('amount')} AS monto_total, {WEEKDAY} AS dia_semana,
           {dbl('COALESCE(s.coin, 0)')} AS coin_in_mda, {dbl('COALESCE(t.coin, 0)')} AS coin_in_mdy
    FROM c LEFT JOIN s USING (d) LEFT JOIN t USING (d)"""
COMPS_TOTALS = f"""
    , c AS (SELECT COUNT(*) AS n, {dbl(money('amount'))} AS amount, COUNT(DISTINCT client_id) AS clients FROM p_comps)
    SELECT n AS total_cortesias, amount AS monto_total, clients AS clientes_unicos,
           {dbl('total_coin.coin')} AS total_coin_in,
           CASE WHEN total_coin.coin > 0
                THEN COALESCE(amount, 0) / {dbl('total_coin.coin')} * 100.0::DOUBLE
                ELSE 0.0::DOUBLE END AS pct_cortesias_coin_in
    FROM c, total_coin"""


# ---- prizes ---------------------------------------------------------------------------------------


def prizes_player(select: str, year: str = "", month: str = "") -> str:
    body = f"""{cut(year, month)}, {SLOT}, {TABLE}, {PRIZE}, base AS (
        SELECT p.client_id, COALESCE(s.full_name, t.client_name, '(Sin nombre)') AS name,
               COALESCE(s.player_level, '-') AS player_level, p.n, {dbl('p.amount')} AS amount,
               {dbl('COALESCE(s.coin, 0) + COALESCE(t.coin, 0)')} AS coin,
               {dbl('COALESCE(s.promo, 0)')} AS promo, CAST(COALESCE(s.games, 0) AS BIGINT) AS games
        FROM prize p LEFT JOIN slot s ON s.player_id = p.client_id
                     LEFT JOIN tab t ON t.client_id = p.client_id)"""
    return f"{views_used(body)} {select}"


PRIZES_BY_PLAYER = f"""SELECT client_id AS cliente_id, name AS nombre, player_level, n AS total_premios,
    amount AS monto_total, coin AS total_coin_in, promo AS total_promo_in, games AS total_games,
    {pct4('amount', 'coin')} AS pct_premio_coin_in FROM base"""
EXPORT_PRIZES = """SELECT client_id AS "ID", name AS "Nombre", player_level AS "Nivel", n AS "Total_Premios",
    amount AS "Monto_Premios", coin AS "Coin_In" FROM base"""
PRIZES_BY_TYPE = f"""SELECT pay_type AS tipo_pago, COUNT(*) AS cantidad, {dbl(money('amount'))} AS monto_total,
    {dbl(money('amount'))} / (SELECT {dbl(money('amount'))} FROM prizes) * 100.0::DOUBLE AS pct_total
    FROM prizes GROUP BY pay_type"""


# ---- summary --------------------------------------------------------------------------------------


def summary(select: str, year: str = "", month: str = "") -> str:
    body = f"""{cut(year, month)}, {SLOT}, {TABLE}, {PRIZE}, {VOUCHER}, {TOTAL_COIN}, base AS (
        SELECT s.player_id, s.full_name, s.player_level, {dbl('s.coin + COALESCE(t.coin, 0)')} AS coin,
               {dbl('s.promo')} AS promo, CAST(s.games AS BIGINT) AS games, s.days,
               COALESCE(v.n, 0) AS comps, {dbl('COALESCE(v.amount, 0)')} AS comp_amount,
               COALESCE(p.n, 0) AS prizes, {dbl('COALESCE(p.amount, 0)')} AS prize_amount,
               {dbl('total_coin.coin')} AS all_coin
        FROM slot s LEFT JOIN voucher v ON v.client_id = s.player_id
                    LEFT JOIN prize p ON p.client_id = s.player_id
                    LEFT JOIN tab t ON t.client_id = s.player_id CROSS JOIN total_coin
        WHERE COALESCE(v.n, 0) > 0 OR COALESCE(p.n, 0) > 0)"""
    return f"{views_used(body)} {select}"


SUMMARY_PLAYERS = f"""SELECT player_id, full_name, player_level, coin AS total_coin_in, promo AS total_promo_in,
    games AS total_games, days AS dias_jugados, comps AS total_cortesias, comp_amount AS monto_cortesias,
    prizes AS total_premios, prize_amount AS monto_premios,
    CASE WHEN all_coin > 0 THEN {half_even('coin * 100.0::DOUBLE / all_coin', 3)} ELSE 0.0::DOUBLE END
        AS pct_total_coin_in FROM base"""
EXPORT_SUMMARY = f"""SELECT player_id AS "ID", full_name AS "Nombre", player_level AS "Nivel", coin AS "Coin_In",
    promo AS "Promo_In", games AS "Juegos", days AS "Dias", comps AS "Cortesias", comp_amount AS "Monto_Cortesias",
    prizes AS "Premios", prize_amount AS "Monto_Premios",
    {pct4('(comp_amount + prize_amount)', 'coin')} AS "Pct_Total_CoinIn" FROM base"""
SUMMARY_KPIS = f"""
    , k AS (SELECT {dbl('(SELECT coin FROM total_coin)')} AS coin,
        (SELECT {dbl(f"COALESCE({money('promo_in')}, 0)")} FROM p_play) AS promo,
        (SELECT CAST(COALESCE(SUM(total_games), 0) AS BIGINT) FROM p_play) AS games,
        (SELECT COUNT(DISTINCT player_id) FROM p_play) AS players,
        (SELECT {dbl(f"COALESCE({money('amount')}, 0)")} FROM p_comps) AS comps,
        (SELECT COUNT(DISTINCT client_id) FROM p_comps) AS comp_clients,
        (SELECT {dbl(f"COALESCE({money('amount')}, 0)")} FROM p_prizes) AS prizes,
        (SELECT COUNT(DISTINCT client_id) FROM p_prizes) AS prize_clients)
    , kpis AS (SELECT coin AS total_coin_in, promo AS total_promo_in, games AS total_games,
        players AS jugadores_srw, comps AS total_cortesias, comp_clients AS clientes_cortesias,
        prizes AS total_premios, prize_clients AS clientes_premios,
        CASE WHEN coin <> 0 THEN (comps + prizes) / coin * 100.0::DOUBLE ELSE 0.0::DOUBLE END AS pct_total FROM k)"""


# ---- controls -------------------------------------------------------------------------------------

SLOT_PLAYERS = f"""players AS (
    SELECT s.player_id AS client_id, s.full_name AS nombre, s.player_level AS nivel, s.coin, s.days FROM slot s)"""
TABLE_PLAYERS = """players AS (
    SELECT t.client_id, t.client_name AS nombre, COALESCE(l.player_level, 'MDJ') AS nivel, t.coin, t.days
    FROM tab t LEFT JOIN (SELECT player_id, MAX(player_level) AS player_level FROM play GROUP BY player_id) l
         ON l.player_id = t.client_id)"""
ALL_PLAYERS = f"""{BOTH_DAYS}, players AS (
    SELECT s.player_id AS client_id, s.full_name AS nombre, s.player_level AS nivel,
           s.coin + COALESCE(t.coin, 0) AS coin, b.days
    FROM slot s JOIN both_days b ON b.client_id = s.player_id LEFT JOIN tab t ON t.client_id = s.player_id
    UNION ALL
    SELECT t.client_id, t.client_name, 'MDJ', t.coin, t.days
    FROM tab t WHERE t.client_id NOT IN (SELECT player_id FROM p_play))"""
DAY_SETS = {
    "all": "SELECT gaming_date AS d FROM p_play UNION SELECT op_date FROM p_points",
    "slot": "SELECT gaming_date AS d FROM p_play",
    "table": "SELECT op_date AS d FROM p_points",
}
PLAYER_SETS = {"all": ALL_PLAYERS, "slot": SLOT_PLAYERS, "table": TABLE_PLAYERS}


def control(kind: str, select: str, year: str = "", month: str = "", chosen: str = "TRUE") -> str:
    """``rated``: players with a voucher, their rates and allowance."""
    grouped = """given AS (SELECT client_id, NULL AS user_id, n, amount FROM voucher)"""
    if "g.user_id" in select:
        grouped = f"""given AS (SELECT client_id, user_id, COUNT(*) AS n, {money('amount')} AS amount
                                FROM v_comps GROUP BY client_id, user_id)"""
    body = f"""{cut(year, month, chosen)}, {SLOT}, {TABLE}, {PRIZE}, {VOUCHER}, {PLAYER_SETS[kind]}, {grouped},
      span AS (SELECT CASE WHEN COUNT(DISTINCT d) = 0 THEN 1 ELSE COUNT(DISTINCT d) END AS days
               FROM ({DAY_SETS[kind]})),
      prim AS (SELECT COALESCE(MAX(pct), 0) AS pct FROM tiers WHERE category = 'Primario'),
      rated AS (
        SELECT pl.nombre, pl.nivel, pl.days, {dbl('pl.coin')} AS coin, g.n AS comps, {dbl('g.amount')} AS spent,
               g.user_id, COALESCE(p.n, 0) AS prizes, {dbl('COALESCE(p.amount, 0)')} AS prize_amount,
               COALESCE(ti.pct, 0.0::DOUBLE) AS pct_cat,
               {dbl('pl.coin')} * prim.pct * COALESCE(ti.pct, 0.0::DOUBLE) AS invited,
               {half_even('CAST(pl.days AS DOUBLE) * 100.0::DOUBLE / span.days', 1)} AS asistencia
        FROM players pl JOIN given g ON g.client_id = pl.client_id
             LEFT JOIN prize p ON p.client_id = pl.client_id
             LEFT JOIN tiers ti ON ti.category = pl.nivel AND ti.category <> 'Primario'
             CROSS JOIN span CROSS JOIN prim)"""
    return f"{views_used(body)} {select}"


def shown_control(*more: str) -> str:
    return f"""SELECT nombre, nivel, days AS dias_asistidos, asistencia AS pct_asistencia, prizes AS cant_premios,
        prize_amount AS monto_premios, coin AS coin_in_mensual, comps AS total_cortesias, spent AS monto_micros,
        CAST(ROUND_EVEN(invited, 0) AS BIGINT) AS invitacion_mensual,
        CAST(ROUND_EVEN(invited - spent, 0) AS BIGINT) AS saldo{''.join(', ' + m for m in more)} FROM rated g"""


def exported_control(managers: bool) -> str:
    more, source = "", "FROM rated g"
    if managers:
        more = """, COALESCE(m.area, '') AS "Area", COALESCE(m.name, '') AS "Autorizo" """
        source = "FROM rated g LEFT JOIN managers m ON m.user_id = g.user_id"
    return f"""SELECT nombre AS "Nombre", nivel AS "Nivel", days AS "Dias", asistencia AS "Pct_Asistencia",
        prizes AS "Premios", prize_amount AS "Monto_Premios", coin AS "Coin_In",
        CAST(ROUND_EVEN(invited, 0) AS BIGINT) AS "Invitacion_Max", comps AS "Cortesias_Cant",
        spent AS "Cortesias_Monto", CAST(ROUND_EVEN(invited - spent, 0) AS BIGINT) AS "Saldo"{more} {source}"""


def kpis(kind: str) -> str:
    coin = {
        "all": "(SELECT coin FROM total_coin)",
        "slot": f"COALESCE((SELECT {money('coin_in')} FROM p_play), 0)",
        "table": f"COALESCE((SELECT {money('coin_in_points')} FROM p_points), 0)",
    }[kind]
    return over_comps(f"""
        , k AS (SELECT (SELECT {dbl(f"COALESCE({money('amount')}, 0)")} FROM p_comps) AS given,
                       {dbl(coin)} AS coin,
                       (SELECT COUNT(DISTINCT d) FROM ({DAY_SETS[kind]})) AS days,
                       (SELECT pct FROM tiers WHERE category = 'Primario') AS prim)
        SELECT given AS total_cortesias_periodo, coin AS total_coin_in_periodo,
               CASE WHEN coin > 0 THEN {half_even('given * 100.0::DOUBLE / coin', 3)} ELSE 0.0::DOUBLE END
                   AS pct_cortesias_coin_in,
               days AS dias_totales, prim AS pct_primario FROM k""")


def chart(rows: str, area: str = "") -> str:
    label, chosen = ("name", f"m.area = '{area}'") if area else ("area", "m.area <> ''")
    return f"""slices AS (SELECT m.{label} AS label, COUNT(*) AS n FROM {rows} c JOIN managers m USING (user_id)
                          WHERE {chosen} GROUP BY m.{label})
        SELECT COALESCE(NULLIF(label, ''), 'Sin asignar') AS etiqueta, n AS cantidad,
               CAST(n AS DOUBLE) / (SELECT SUM(n) FROM slices) * 100.0::DOUBLE AS pct,
               CAST(n AS DOUBLE) / (SELECT SUM(n) FROM slices) > 0.05 AS rotulado FROM slices"""


# ---- audit ----------------------------------------------------------------------------------------

IDLE = """idle AS (
    SELECT c.* FROM v_comps c
    WHERE NOT EXISTS (SELECT 1 FROM play s WHERE s.player_id = c.client_id
                      AND s.gaming_date = c.gaming_date AND s.coin_in > 0)
      AND NOT EXISTS (SELECT 1 FROM points t WHERE t.client_id = c.client_id
                      AND t.op_date = c.gaming_date AND t.coin_in_points > 0))"""


def audit(select: str, year: str = "", month: str = "", chosen: str = "TRUE", per_manager: bool = False) -> str:
    user = "user_id" if per_manager else "MIN(user_id) AS user_id"
    keys = "gaming_date, client_id" + (", user_id" if per_manager else "")
    body = f"""{cut(year, month, chosen)}, {IDLE}, {NAMED}, grp AS (
        SELECT gaming_date, client_id, {user}, COUNT(*) AS n, {money('amount')} AS amount,
               MAX(CASE WHEN TRIM(COALESCE(client_name, '')) <> '' THEN client_name END) AS own_name
        FROM idle GROUP BY {keys}),
      s AS (SELECT player_id, gaming_date, {money('coin_in')} AS coin FROM play GROUP BY ALL),
      t AS (SELECT client_id, op_date, {money('coin_in_points')} AS coin FROM points GROUP BY ALL),
      p AS (SELECT client_id, gaming_date, COUNT(*) AS n, {money('amount')} AS amount FROM prizes GROUP BY ALL),
      base AS (
        SELECT g.gaming_date, g.client_id, {shown_name('g.own_name', 'pn.play_name')} AS name,
               {dbl('COALESCE(s.coin, 0) + COALESCE(t.coin, 0)')} AS coin, g.n AS comps,
               {dbl('g.amount')} AS amount, COALESCE(p.n, 0) AS prizes,
               {dbl('COALESCE(p.amount, 0)')} AS prize_amount,
               COALESCE(m.name, '') AS manager, COALESCE(m.area, '') AS area
        FROM grp g LEFT JOIN s ON s.player_id = g.client_id AND s.gaming_date = g.gaming_date
             LEFT JOIN t ON t.client_id = g.client_id AND t.op_date = g.gaming_date
             LEFT JOIN p ON p.client_id = g.client_id AND p.gaming_date = g.gaming_date
             LEFT JOIN managers m ON m.user_id = g.user_id
             LEFT JOIN play_names pn ON pn.player_id = g.client_id)"""
    return f"{views_used(body)} {select}"


AUDIT = """SELECT gaming_date AS jornada, client_id AS cliente_id, name AS nombre_cliente, coin AS coin_in,
    comps AS cant_cortesias, amount AS monto_cortesias, prizes AS cant_premios, prize_amount AS monto_premios,
    manager AS jefe_nombre, area AS jefe_area FROM base"""
EXPORT_AUDIT = """SELECT gaming_date AS "Jornada", client_id AS "ID", name AS "Nombre", coin AS "Coin_In",
    comps AS "Cortesias", amount AS "Monto_Cortesias", prizes AS "Premios", prize_amount AS "Monto_Premios",
    area AS "Area", manager AS "Autorizo" FROM base"""
AUDIT_LABELS = """SELECT gaming_date AS jornada, client_id AS cliente_id, name AS nombre_cliente, coin AS coin_in,
    comps AS cant_cortesias, amount AS monto_cortesias,
    CASE WHEN prizes > 0 THEN 'Sí (' || prizes || ')' ELSE 'No' END AS premio, prize_amount AS monto_premios,
    CASE WHEN area = '' THEN '—' ELSE area END AS area,
    CASE WHEN manager = '' THEN '—' ELSE manager END AS autorizo FROM base"""


# ---- feeds ----------------------------------------------------------------------------------------

NUMBER = "COALESCE(TRY_CAST({0} AS DOUBLE), 0.0::DOUBLE)"
DAY = """CASE WHEN regexp_matches({0}, '^[0-9]{{4}}-') THEN TRY_CAST({0} AS DATE)
    ELSE CAST(try_strptime({0}, ['%m/%d/%Y', '%m-%d-%Y']) AS DATE) END"""
ID = "REGEXP_REPLACE(TRIM({0}), '[.]0$', '')"
CLEAN = {
    "play": f"""SELECT {DAY.format('_c1')} AS gaming_date, {ID.format('_c2')} AS player_id, _c3 AS full_name,
        _c4 AS player_level, {NUMBER.format('_c5')} AS coin_in,
        CAST({NUMBER.format('_c16')} AS BIGINT) AS total_games, {NUMBER.format('_c10')} AS promo_in
        FROM raw WHERE _c2 IS NOT NULL AND {DAY.format('_c1')} IS NOT NULL""",
    "comps": f"""SELECT {DAY.format('_c6')} AS gaming_date, {ID.format('_c7')} AS client_id, _c10 AS client_name,
        _c14 AS category, _c16 AS product, {NUMBER.format('_c19')} AS amount, _c22 AS status,
        REGEXP_REPLACE(_c28, '[.]0$', '') AS user_id, COALESCE(_c29, '') AS user_name
        FROM raw WHERE _c22 = 'QUEMADO' AND _c7 IS NOT NULL""",
    "prizes": f"""SELECT CAST(try_strptime(_c0, '%d-%m-%Y %H:%M') - INTERVAL 9 HOUR AS DATE) AS gaming_date,
        REGEXP_REPLACE(TRIM(TRIM(_c3), 'x'), '[.]0$', '') AS client_id, {NUMBER.format('_c6')} AS amount,
        _c11 AS pay_type
        FROM raw WHERE _c11 IN ('Jackpot HP', 'Progressive Jackpot HP') AND _c3 IS NOT NULL
        AND try_strptime(_c0, '%d-%m-%Y %H:%M') IS NOT NULL""",
    "points": f"""SELECT {DAY.format('_c1')} AS op_date, {ID.format('_c5')} AS client_id, _c6 AS client_name,
        {NUMBER.format('_c11')} AS points, {NUMBER.format('_c11')} * 1000 AS coin_in_points
        FROM raw WHERE _c5 IS NOT NULL""",
    "managers": f"""SELECT {ID.format('_c0')} AS user_id, COALESCE(_c1, '') AS name, COALESCE(_c2, '') AS area
        FROM raw""",
    "tiers": f"SELECT _c0 AS category, {NUMBER.format('_c1')} AS pct FROM raw WHERE _c0 IS NOT NULL",
}


def clean(feed: str) -> str:
    return f"WITH raw AS ({raw_text(feed).format(**PLAIN)}) {CLEAN[feed]}"


BATCH_RANGE = f"gaming_date BETWEEN DATE '{BATCH[0]}' AND DATE '{BATCH[1]}'"
COMP_COLUMNS = "gaming_date, client_id, client_name, category, product, amount, status, user_id, user_name"
MONTH_NAMES = """CASE mes WHEN '01' THEN 'Enero' WHEN '02' THEN 'Febrero' WHEN '03' THEN 'Marzo'
    WHEN '04' THEN 'Abril' WHEN '05' THEN 'Mayo' WHEN '06' THEN 'Junio' WHEN '07' THEN 'Julio'
    WHEN '08' THEN 'Agosto' WHEN '09' THEN 'Septiembre' WHEN '10' THEN 'Octubre'
    WHEN '11' THEN 'Noviembre' WHEN '12' THEN 'Diciembre' ELSE 'Todos' END"""
ALL_MONTHS = """months AS (SELECT DISTINCT strftime(d, '%Y') AS anio, strftime(d, '%m') AS mes FROM (
    SELECT gaming_date AS d FROM play UNION ALL SELECT gaming_date FROM comps
    UNION ALL SELECT gaming_date FROM prizes UNION ALL SELECT op_date FROM points) WHERE d IS NOT NULL)"""


def plain(select: str) -> str:
    return f"{views_used('')} {select}"


def with_months(select: str) -> str:
    return f"{views_used(ALL_MONTHS)} {select}"


REPLACE_RANGE = plain(f"""SELECT {COMP_COLUMNS} FROM comps WHERE gaming_date IS NULL OR NOT ({BATCH_RANGE})
    UNION ALL SELECT * REPLACE (amount * 2 AS amount) FROM (SELECT {COMP_COLUMNS} FROM comps) WHERE {BATCH_RANGE}""")


STATEMENTS: dict[str, str] = {
    **{f"clean_{feed}": clean(feed) for feed in CLEAN},
    "clean_comps_split_cells": f"""SELECT * REPLACE (CASE WHEN amount > 0 AND CAST(amount AS BIGINT) % 500 = 0
        THEN replace(product, 'P', 'P' || chr(10)) ELSE product END AS product) FROM ({clean('comps')})""",
    "normalize_ids": plain("""SELECT DISTINCT 'prizes' AS feed, client_id AS raw_id, TRIM(client_id, 'x') AS clean_id
        FROM prizes_raw UNION
        SELECT 'comps', user_id, REGEXP_REPLACE(user_id, '[.]0$', '') FROM comps_raw"""),
    "jornada_day": "SELECT event_id, CAST(ts - INTERVAL 9 HOUR AS DATE) AS jornada FROM events",
    "backfill_names": f"""{views_used(NAMED)} SELECT gaming_date, client_id,
        {shown_name('client_name', 'play_name')} AS client_name, category, product, amount, status, user_id, user_name
        FROM comps LEFT JOIN play_names ON player_id = client_id""",
    "replace_range": REPLACE_RANGE,
    "store_replace_range": REPLACE_RANGE,
    "store_repeated_load": REPLACE_RANGE,
    "store_load_log": plain(f"""SELECT 'play' AS table_name, '' AS file_name, COUNT(*) AS rows FROM play
        UNION ALL SELECT 'points', '', COUNT(*) FROM points UNION ALL SELECT 'comps', 'comps.csv', COUNT(*) FROM comps
        UNION ALL SELECT 'comps', 'again.csv', COUNT(*) FROM comps WHERE {BATCH_RANGE}
        UNION ALL SELECT 'managers', 'managers.csv', COUNT(*) FROM managers"""),
    "batch_bounds": plain(f"""SELECT MIN(gaming_date) AS first_day, MAX(gaming_date) AS last_day
        FROM comps WHERE {BATCH_RANGE}"""),
    "table_counts": plain(" UNION ALL ".join(f"SELECT '{t}' AS tabla, COUNT(*) AS cnt FROM {t}" for t in LEDGER_DAYS)),
    "filter_period_year": plain(f"SELECT * FROM play WHERE {where_period('gaming_date', YEAR)}"),
    "filter_period_month": plain(f"SELECT * FROM play WHERE {where_period('gaming_date', YEAR, MONTH)}"),
    "filter_period_month_only": plain(f"SELECT * FROM play WHERE {where_period('gaming_date', '', MONTH)}"),
    "filter_years": with_months("SELECT DISTINCT anio FROM months"),
    "filter_months": with_months("SELECT DISTINCT mes FROM months"),
    "filter_areas": plain("SELECT DISTINCT area FROM managers WHERE area <> ''"),
    "filter_managers": plain("SELECT user_id AS usuario_id, name AS nombre FROM managers"),
    "filter_managers_area": plain(f"SELECT user_id AS usuario_id, name AS nombre FROM managers WHERE area = '{AREA}'"),
    "period_label": with_months(f""", choices AS (
        SELECT anio, mes FROM months UNION SELECT anio, '' FROM months
        UNION SELECT '', mes FROM months UNION SELECT '', '')
        SELECT anio, mes, COALESCE(NULLIF(anio, ''), 'Todos') || '-' || {MONTH_NAMES} AS periodo FROM choices"""),
    "period_days_all": over_comps(f"SELECT COUNT(DISTINCT d) AS period_days FROM ({DAY_SETS['all']})"),
    "player_days_all": f"""{views_used(cut() + ', ' + BOTH_DAYS)}
        SELECT client_id AS cliente_id, days AS dias_combinados FROM both_days""",
    "player_profile": f"""{views_used(cut() + ', ' + SLOT)}
        SELECT player_id, n AS filas, full_name, player_level, {dbl('coin')} AS total_coin_in,
               {dbl('promo')} AS total_promo_in, CAST(games AS BIGINT) AS total_games FROM slot""",
    "points_only_players": plain("""SELECT DISTINCT client_id FROM points
        WHERE client_id NOT IN (SELECT player_id FROM play)"""),
    "comps_by_player": comps_player(COMPS_BY_PLAYER),
    "comps_by_player_month": comps_player(COMPS_BY_PLAYER, YEAR, MONTH),
    "store_comps_by_player_month": comps_player(COMPS_BY_PLAYER, YEAR, MONTH),
    "comps_by_category": over_comps(COMPS_BY_CATEGORY),
    "comps_by_product": over_comps(COMPS_BY_PRODUCT),
    "comps_products_nested": over_comps(COMPS_NESTED),
    "comps_by_day": over_comps(COMPS_BY_DAY),
    "comps_totals": over_comps(COMPS_TOTALS),
    "comps_totals_month": over_comps(COMPS_TOTALS, YEAR, MONTH),
    "comps_with_manager": plain("""SELECT c.*, COALESCE(m.name, '') AS jefe_nombre, COALESCE(m.area, '') AS jefe_area
        FROM comps c LEFT JOIN managers m ON m.user_id = c.user_id"""),
    "comps_in_area": plain(f"SELECT * FROM comps WHERE {in_area(AREA)}"),
    "comps_by_manager": plain(f"SELECT * FROM comps WHERE {by_manager(MANAGER)}"),
    "daily_comps_json": plain(f"""SELECT '{{"fecha":"' || gaming_date || '","monto":' || {dbl(money('amount'))} || '}}'
        AS fila FROM comps WHERE gaming_date IS NOT NULL GROUP BY gaming_date"""),
    "daily_play": plain(f"""SELECT gaming_date AS fecha, {dbl(money('coin_in'))} AS monto
        FROM play GROUP BY gaming_date"""),
    "prizes_by_player": prizes_player(PRIZES_BY_PLAYER),
    "prizes_by_player_month": prizes_player(PRIZES_BY_PLAYER, YEAR, MONTH),
    "prizes_by_type": plain(PRIZES_BY_TYPE),
    "prizes_by_day": plain(f"""SELECT gaming_date AS fecha_jornada, COUNT(*) AS cantidad,
        {dbl(money('amount'))} AS monto_total FROM prizes WHERE gaming_date IS NOT NULL GROUP BY gaming_date"""),
    "prizes_totals": plain(f"""SELECT COUNT(*) AS total_premios, {dbl(money('amount'))} AS monto_total,
        COUNT(DISTINCT client_id) AS clientes_unicos FROM prizes"""),
    "prize_types_all": plain(f"""SELECT pay_type AS tipo, COUNT(*) AS cantidad, {dbl(money('amount'))} AS monto
        FROM prizes GROUP BY pay_type"""),
    "summary_kpis": over_comps(SUMMARY_KPIS + " SELECT * FROM kpis"),
    "summary_players": summary(SUMMARY_PLAYERS),
    "summary_players_month": summary(SUMMARY_PLAYERS, YEAR, MONTH),
    "control_all": control("all", shown_control("pct_cat")),
    "store_control_all": control("all", shown_control("pct_cat")),
    "control_all_month": control("all", shown_control("pct_cat"), YEAR, MONTH),
    "control_all_area": control("all", shown_control("pct_cat"), chosen=in_area(AREA)),
    "control_all_manager": control("all", shown_control("pct_cat"), chosen=by_manager(MANAGER)),
    "control_kpis": kpis("all"),
    "control_slots": control("slot", shown_control(), chosen=in_area("MDA")),
    "control_slots_manager": control("slot", shown_control(), chosen=by_manager(MANAGER)),
    "control_slots_kpis": kpis("slot"),
    "control_tables": control("table", shown_control(), chosen=in_area("MDJ")),
    "control_tables_month": control("table", shown_control(), YEAR, MONTH, in_area("MDJ")),
    "control_tables_kpis": kpis("table"),
    "chart_by_area": views_used(chart("comps")),
    "chart_by_manager": views_used(chart("comps", AREA)),
    "audit_zero_play": audit(AUDIT),
    "audit_zero_play_month": audit(AUDIT, YEAR, MONTH),
    "audit_zero_area": audit(AUDIT, chosen=in_area(AREA)),
    "audit_zero_manager": audit(AUDIT, chosen=by_manager(MANAGER)),
    "audit_zero_vouchers": f"{views_used(cut() + ', ' + IDLE)} SELECT {COMP_COLUMNS} FROM idle",
    "audit_chart_by_area": views_used(f"{cut()}, {IDLE}, {chart('idle')}"),
    "audit_chart_by_manager": views_used(f"{cut()}, {IDLE}, {chart('idle', AREA)}"),
    "flags_players": comps_player(
        f"SELECT *, pct_cortesia_coin_in > 1 AS alerta FROM ({COMPS_BY_PLAYER})"
    ),
    "flags_prizes": prizes_player(f"SELECT *, pct_premio_coin_in > 50 AS alerta FROM ({PRIZES_BY_PLAYER})"),
    "flags_balance": control("all", f"SELECT *, saldo >= 0 AS saldo_disponible FROM ({shown_control('pct_cat')})"),
    "flags_kpis": over_comps(SUMMARY_KPIS + " SELECT *, pct_total > 5 AS alerta FROM kpis"),
    "tier_label": plain("""SELECT nivel, REPLACE(REPLACE(nivel, 'DREAMS ', 'D.'), 'DREAMS', 'D.') AS nivel_corto FROM (
        SELECT DISTINCT UNNEST([player_level, 'DREAMS ' || player_level, 'DREAMS' || player_level]) AS nivel FROM play)"""),
    "audit_zero_labels": audit(AUDIT_LABELS),
    "sorted_report": prizes_player(PRIZES_BY_PLAYER),
    "export_comps": comps_player(EXPORT_COMPS),
    "export_prizes": prizes_player(EXPORT_PRIZES),
    "export_summary": summary(EXPORT_SUMMARY),
    "export_control": control("all", exported_control(True)),
    "export_slots": control("slot", exported_control(False), chosen=in_area("MDA")),
    "export_tables": control("table", exported_control(False), chosen=in_area("MDJ")),
    "export_audit": audit(EXPORT_AUDIT, per_manager=True),
}

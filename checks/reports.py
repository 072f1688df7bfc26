"""Report queries and the SQL they are checked against."""

from __future__ import annotations

from checks.common import AS_OF, on_bank
from ledgerkit.plans import reports as r

TX = """tx AS (SELECT l_orderkey AS account_id, l_linenumber AS line, l_partkey AS part_id,
 l_suppkey AS supplier_id, l_returnflag AS type, l_linestatus AS state,
 CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, l_shipdate AS ts FROM lineitem)"""
ACC = """acc AS (SELECT o_orderkey AS account_id, o_custkey AS client_id, o_orderstatus AS state,
 o_orderpriority AS type, CAST(o_totalprice AS DECIMAL(18,2)) AS balance, o_orderdate AS opened
 FROM orders)"""
CLI = """cli AS (SELECT c_custkey AS client_id, c_name AS name, c_mktsegment AS segment,
 c_nationkey AS branch_id, CAST(c_acctbal AS DECIMAL(18,2)) AS credit FROM customer)"""
STAR = f"WITH {TX}, {ACC}, {CLI}"

STATEMENT_CLIENT = f"""{STAR}, m AS (SELECT *, sum(CASE WHEN type = 'A' THEN amount ELSE -amount END)
 OVER (PARTITION BY account_id ORDER BY ts, line, part_id, supplier_id ROWS UNBOUNDED PRECEDING)
 AS running FROM tx WHERE ts >= DATE '1998-01-01' AND ts < DATE '1999-01-01')
 SELECT account_id, client_id, CAST(balance AS DOUBLE) AS balance, CAST(line AS BIGINT) AS line,
 part_id, supplier_id, m.type AS type, CAST(amount AS DOUBLE) AS amount, ts,
 CAST(running AS DOUBLE) AS running FROM acc LEFT JOIN m USING (account_id) WHERE client_id = 77"""

QUERIES = {
    "movement_report": on_bank(lambda b: r.movement_report(b, "1998-01-01", "1998-04-01")),
    "monthly_report": on_bank(lambda b: r.monthly_report(b, 1998, 3, top=100, page=2, size=20)),
    "month_over_month": on_bank(lambda b: r.month_over_month(b, 1998, 3)),
    "top_clients": on_bank(lambda b: r.top_clients(b, 100, "1997-01-01", "1999-01-01")),
    "monthly_by_account": on_bank(lambda b: r.monthly_by_account(b, 1998, 5)),
    "closing_report": on_bank(lambda b: r.closing_report(b, "1998-01-01", "1999-01-01")),
    "statement": on_bank(lambda b: r.statement(b, None, "1998-01-01", "1999-01-01").drop("state")),
    "concentration": on_bank(lambda b: r.concentration(b, "1998-01-01", "1999-01-01")[0]),
    "concentration_clients": on_bank(lambda b: r.concentration(b, "1998-01-01", "1999-01-01")[1]),
    "month_top_accounts": on_bank(lambda b: r.month_analysis(b, 1998, 3)[0]),
    "month_by_type": on_bank(lambda b: r.month_analysis(b, 1998, 3)[1]),
    "month_totals": on_bank(lambda b: r.month_analysis(b, 1998, 3)[2]),
    "inactive_clients": on_bank(lambda b: r.inactive_clients(b, 150, AS_OF)[0]),
    "inactive_segments": on_bank(lambda b: r.inactive_clients(b, 150, AS_OF)[1]),
    "inactive_total": on_bank(
        lambda b: r.inactive_clients(b, 150, AS_OF, ["BUILDING", "MACHINERY"])[2]),
    "client_report": on_bank(lambda b: r.client_report(b, AS_OF)),
    "client_summary": on_bank(lambda b: r.client_summary(b)),
    "segment_summary": on_bank(lambda b: r.segment_summary(r.client_summary(b))),
    "consolidated": on_bank(r.consolidated),
    "day_summary": on_bank(lambda b: r.day_summary(b, "1998-03-01", "1998-03-08")),
    "day_detail": on_bank(lambda b: r.day_detail(b, "1998-03-02", "1998-03-03")),
    "dashboard": on_bank(lambda b: r.dashboard(b, AS_OF)),
    "year_month": on_bank(r.year_month),
    "heavy_months": on_bank(lambda b: r.heavy_months(b, 5, 100000)),
    "frequent_large": on_bank(lambda b: r.frequent_large(b, 40000, 5)),
    "clients_over": on_bank(lambda b: r.clients_over(b, 2000000)),
    "annual_report": on_bank(lambda b: r.annual_report(b, 1998)),
    "find_transactions": on_bank(
        lambda b: r.find_transactions(b, "1997-01-01", "1997-12-31", kind="R", min_amount=30000)),
}

_MOM = f"""{STAR}, m AS (SELECT client_id, count(*) FILTER (ts >= DATE '1998-03-01') AS tx_count,
 sum(CASE WHEN ts >= DATE '1998-03-01' THEN amount ELSE 0 END) AS amount,
 sum(CASE WHEN ts < DATE '1998-03-01' THEN amount ELSE 0 END) AS previous_amount
 FROM tx JOIN acc USING (account_id)
 WHERE ts >= DATE '1998-02-01' AND ts < DATE '1998-04-01' AND tx.state = 'F' GROUP BY client_id),
mom AS (SELECT client_id, name, segment, tx_count, amount, previous_amount,
 amount - previous_amount AS change,
 CASE WHEN previous_amount > 0
  THEN CAST(amount - previous_amount AS DOUBLE) * 100.0 / CAST(previous_amount AS DOUBLE)
  ELSE 100.0 END AS change_pct,
 CASE WHEN amount > previous_amount THEN 'growth' WHEN amount < previous_amount THEN 'decline'
  ELSE 'unchanged' END AS trend
 FROM m JOIN cli USING (client_id) WHERE tx_count > 0)"""

_STANDING = """*, row_number() OVER (ORDER BY amount DESC, client_id) AS ranking,
 dense_rank() OVER (ORDER BY amount DESC) AS dense_ranking,
 percent_rank() OVER (ORDER BY amount) AS standing,
 sum(amount) OVER (ORDER BY amount DESC, client_id ROWS UNBOUNDED PRECEDING) AS running_amount,
 sum(amount) OVER () AS total,
 lag(amount, 1, amount) OVER (ORDER BY amount DESC, client_id) AS above"""
_CATEGORY = """CASE WHEN standing >= 0.95 THEN 'Top 5%' WHEN standing >= 0.90 THEN 'Top 10%'
 WHEN standing >= 0.75 THEN 'Top 25%' ELSE 'Regular' END AS category"""


def _share(part: str, whole: str = "total") -> str:
    return f"round(CAST({part} AS DOUBLE) * 100.0 / CAST({whole} AS DOUBLE), 4)"


def _sums(kinds: str = "ANW") -> str:
    return """sum(CASE WHEN type = 'A' THEN amount ELSE 0 END) AS deposits,
 sum(CASE WHEN type = 'N' THEN amount ELSE 0 END) AS withdrawals"""


_ACTIVITY = f"""{STAR}, bal AS (SELECT client_id, count(*) AS accounts, sum(balance) AS balance,
 max(opened) AS last_opened FROM acc GROUP BY client_id),
mv AS (SELECT client_id, count(*) AS tx_count, max(ts) AS last_tx
 FROM tx JOIN acc USING (account_id) GROUP BY client_id)"""
_IDLE = f"""{_ACTIVITY}, idle AS (SELECT client_id, name, segment, last_tx,
 date_diff('day', last_tx, TIMESTAMP '2001-12-01') AS days_idle,
 coalesce(balance, 0) AS balance FROM cli LEFT JOIN mv USING (client_id)
 LEFT JOIN bal USING (client_id)
 WHERE last_tx IS NULL OR date_diff('day', last_tx, TIMESTAMP '2001-12-01') >= 150)"""
_CONC = f"""{STAR}, c AS (SELECT client_id, name, segment, {_sums()}, count(*) AS tx_count,
 max(ts) AS last_tx, sum(CASE WHEN type IN ('A','N') THEN amount ELSE 0 END) AS volume
 FROM (SELECT * EXCLUDE (state) FROM tx) JOIN (SELECT account_id, client_id FROM acc)
 USING (account_id) JOIN cli USING (client_id)
 WHERE ts >= DATE '1998-01-01' AND ts < DATE '1999-01-01' GROUP BY 1, 2, 3)"""
_MONTH = f"""{STAR}, m AS (SELECT * FROM tx WHERE ts >= DATE '1998-03-01' AND ts < DATE '1998-04-01')"""

SQL = {
    "movement_report": f"""{STAR} SELECT client_id, name, segment, account_id,
 acc.type AS account_type, tx.type AS tx_type, count(*) AS tx_count,
 CAST(sum(amount) AS DOUBLE) AS amount, round(CAST(sum(amount) AS DOUBLE) / count(*), 4) AS average,
 CAST(min(amount) AS DOUBLE) AS smallest, CAST(max(amount) AS DOUBLE) AS largest
 FROM tx JOIN acc USING (account_id) JOIN cli USING (client_id)
 WHERE ts >= DATE '1998-01-01' AND ts < DATE '1998-04-01' AND tx.state = 'F'
 GROUP BY ALL""",
    "monthly_report": f"""{_MOM}, s AS (SELECT {_STANDING} FROM mom),
 t AS (SELECT *, count(*) OVER () AS total_rows FROM s WHERE ranking <= 100)
 SELECT ranking, client_id, name, segment, tx_count, CAST(amount AS DOUBLE) AS amount,
 CAST(previous_amount AS DOUBLE) AS previous_amount, CAST(change AS DOUBLE) AS change,
 round(change_pct, 4) AS change_pct, trend, {_share('amount')} AS share_pct,
 {_share('running_amount')} AS running_share_pct, {_CATEGORY}, total_rows,
 CAST(2 AS BIGINT) AS page, CAST(ceil(total_rows / 20) AS BIGINT) AS total_pages
 FROM t WHERE ranking > 20 AND ranking <= 40""",
    "month_over_month": f"""{_MOM} SELECT client_id, name, segment, tx_count,
 CAST(amount AS DOUBLE) AS amount, CAST(previous_amount AS DOUBLE) AS previous_amount,
 CAST(change AS DOUBLE) AS change, round(change_pct, 4) AS change_pct, trend FROM mom""",
    "top_clients": f"""{STAR}, c AS (SELECT client_id, name, segment, count(*) AS tx_count,
 sum(amount) AS amount FROM tx JOIN acc USING (account_id) JOIN cli USING (client_id)
 WHERE ts >= DATE '1997-01-01' AND ts < DATE '1999-01-01' AND tx.state = 'F' GROUP BY ALL),
 s AS (SELECT {_STANDING} FROM c)
 SELECT ranking, dense_ranking, client_id, name, segment, tx_count,
 CAST(amount AS DOUBLE) AS amount, {_share('amount')} AS share_pct,
 CAST(running_amount AS DOUBLE) AS running_amount,
 {_share('running_amount')} AS running_share_pct, CAST(amount - above AS DOUBLE) AS gap,
 {_CATEGORY} FROM s WHERE ranking <= 100""",
    "monthly_by_account": f"""{STAR} SELECT account_id, client_id, CAST(balance AS DOUBLE) AS balance,
 CAST(coalesce(deposits, 0) AS DOUBLE) AS deposits,
 CAST(coalesce(withdrawals, 0) AS DOUBLE) AS withdrawals,
 CAST(coalesce(transfers, 0) AS DOUBLE) AS transfers, coalesce(tx_count, 0) AS tx_count
 FROM acc LEFT JOIN (SELECT account_id, {_sums()},
 sum(CASE WHEN type = 'R' THEN amount ELSE 0 END) AS transfers, count(*) AS tx_count FROM tx
 WHERE ts >= DATE '1998-05-01' AND ts < DATE '1998-06-01' GROUP BY account_id) USING (account_id)""",
    "closing_report": f"""{STAR}, m AS (SELECT account_id, {_sums()}, count(*) AS tx_count FROM tx
 WHERE ts >= DATE '1998-01-01' AND ts < DATE '1999-01-01' GROUP BY account_id)
 SELECT type, count(*) AS accounts, count(DISTINCT client_id) AS clients,
 CAST(sum(balance) AS DOUBLE) AS balance,
 CAST(min(CASE WHEN balance > 0 THEN balance END) AS DOUBLE) AS smallest_positive,
 count(tx_count) AS active_accounts, CAST(coalesce(sum(tx_count), 0) AS BIGINT) AS tx_count,
 CAST(coalesce(sum(deposits), 0) AS DOUBLE) AS deposits,
 CAST(coalesce(sum(withdrawals), 0) AS DOUBLE) AS withdrawals
 FROM acc LEFT JOIN m USING (account_id) GROUP BY type""",
    "statement": f"""{STAR}, m AS (SELECT *, sum(CASE WHEN type = 'A' THEN amount ELSE -amount END)
 OVER (PARTITION BY account_id ORDER BY ts, line, part_id, supplier_id ROWS UNBOUNDED PRECEDING)
 AS running FROM tx WHERE ts >= DATE '1998-01-01' AND ts < DATE '1999-01-01')
 SELECT account_id, client_id, CAST(balance AS DOUBLE) AS balance, CAST(line AS BIGINT) AS line,
 part_id, supplier_id, m.type AS type, CAST(amount AS DOUBLE) AS amount, ts,
 CAST(running AS DOUBLE) AS running FROM acc LEFT JOIN m USING (account_id)""",
    "concentration": f"""{_CONC} SELECT segment, count(*) AS clients,
 CAST(sum(deposits) AS DOUBLE) AS deposits, CAST(sum(withdrawals) AS DOUBLE) AS withdrawals,
 CAST(sum(volume) AS DOUBLE) AS volume,
 round(CAST(sum(tx_count) AS DOUBLE) / count(*), 4) AS average_tx,
 {_share('sum(volume)', '(SELECT sum(volume) FROM c)')} AS share_pct,
 CASE WHEN sum(volume) * 100.0 / (SELECT sum(volume) FROM c) > 40 THEN 'HIGH'
  WHEN sum(volume) * 100.0 / (SELECT sum(volume) FROM c) > 20 THEN 'MEDIUM' ELSE 'LOW' END AS risk
 FROM c GROUP BY segment""",
    "concentration_clients": f"""{_CONC} SELECT client_id, name, segment,
 CAST(deposits AS DOUBLE) AS deposits, CAST(withdrawals AS DOUBLE) AS withdrawals, tx_count,
 last_tx, CAST(volume AS DOUBLE) AS volume FROM c ORDER BY c.volume DESC, client_id LIMIT 20""",
    "month_top_accounts": f"""{_MONTH} SELECT account_id, count(*) AS tx_count,
 CAST(sum(m.amount) AS DOUBLE) AS amount FROM m GROUP BY account_id
 ORDER BY sum(m.amount) DESC, account_id LIMIT 10""",
    "month_by_type": f"""{_MONTH} SELECT type, count(*) AS tx_count,
 CAST(sum(m.amount) AS DOUBLE) AS amount,
 round(CAST(sum(m.amount) AS DOUBLE) / count(*), 4) AS average FROM m GROUP BY type""",
    "month_totals": f"""{_MONTH} SELECT count(*) AS tx_count, CAST(sum(m.amount) AS DOUBLE) AS amount,
 count(DISTINCT account_id) AS accounts, CAST(max(m.amount) AS DOUBLE) AS largest FROM m""",
    "inactive_clients": f"""{_IDLE} SELECT client_id, name, segment, last_tx, days_idle,
 CAST(balance AS DOUBLE) AS balance FROM idle""",
    "inactive_segments": f"""{_IDLE} SELECT segment, count(*) AS clients,
 CAST(sum(balance) AS DOUBLE) AS dormant FROM idle GROUP BY segment""",
    "inactive_total": f"""{_IDLE} SELECT count(*) AS clients,
 CAST(sum(balance) AS DOUBLE) AS dormant FROM idle WHERE segment IN ('BUILDING', 'MACHINERY')""",
    "client_report": f"""{_ACTIVITY} SELECT client_id, name, segment,
 coalesce(accounts, 0) AS accounts, CAST(coalesce(balance, 0) AS DOUBLE) AS balance,
 coalesce(tx_count, 0) AS tx_count, last_tx,
 date_diff('day', last_tx, TIMESTAMP '2001-12-01') AS days_idle,
 CASE WHEN last_tx >= DATE '2001-11-01' THEN 'active' WHEN last_tx >= DATE '2001-09-01'
  THEN 'moderate' ELSE 'inactive' END AS activity
 FROM cli LEFT JOIN bal USING (client_id) LEFT JOIN mv USING (client_id)""",
    "client_summary": f"""{_ACTIVITY} SELECT client_id, name, segment, accounts,
 CAST(balance AS DOUBLE) AS balance, tx_count, last_tx,
 CASE WHEN bal.balance >= 500000 THEN 'VIP' WHEN bal.balance >= 100000 THEN 'Premium'
  WHEN bal.balance >= 10000 THEN 'Standard' ELSE 'Basic' END AS tier
 FROM cli LEFT JOIN bal USING (client_id) LEFT JOIN mv USING (client_id)""",
    "segment_summary": f"""{_ACTIVITY}, s AS (SELECT segment, accounts, balance,
 CASE WHEN balance >= 500000 THEN 'VIP' WHEN balance >= 100000 THEN 'Premium'
  WHEN balance >= 10000 THEN 'Standard' ELSE 'Basic' END AS tier
 FROM cli LEFT JOIN bal USING (client_id))
 SELECT segment, tier, count(*) AS clients, CAST(sum(s.balance) AS DOUBLE) AS balance,
 round(CAST(sum(accounts) AS DOUBLE) / count(*), 4) AS average_accounts
 FROM s GROUP BY segment, tier""",
    "consolidated": f"""{_ACTIVITY} SELECT client_id, CAST(coalesce(balance, 0) AS DOUBLE) AS balance,
 coalesce(accounts, 0) AS accounts, last_opened FROM cli LEFT JOIN bal USING (client_id)""",
    "day_summary": f"""{STAR} SELECT strftime(ts, '%Y-%m-%d') AS day, type, count(*) AS tx_count,
 CAST(sum(tx.amount) AS DOUBLE) AS amount, count(*) FILTER (state = 'F') AS completed,
 CAST(sum(CASE WHEN state <> 'F' THEN tx.amount END) AS DOUBLE) AS open_amount
 FROM tx WHERE ts >= DATE '1998-03-01' AND ts < DATE '1998-03-08' GROUP BY 1, 2""",
    "day_detail": f"""{STAR} SELECT account_id, CAST(line AS BIGINT) AS line, part_id, supplier_id,
 tx.type AS type, tx.state AS state, CAST(amount AS DOUBLE) AS amount, ts, client_id,
 acc.state AS account_state, opened FROM tx LEFT JOIN acc USING (account_id)
 WHERE ts >= DATE '1998-03-02' AND ts < DATE '1998-03-03'""",
    "dashboard": f"""{STAR} SELECT 'tx_last_30_days' AS metric, CAST(count(*) AS DOUBLE) AS value
 FROM tx WHERE ts >= DATE '2001-11-01' AND ts <= DATE '2001-12-01'
 UNION ALL SELECT 'amount_last_30_days', CAST(sum(amount) AS DOUBLE) FROM tx
 WHERE ts >= DATE '2001-11-01' AND ts <= DATE '2001-12-01'
 UNION ALL SELECT 'open_transactions', CAST(count(*) AS DOUBLE) FROM tx
 WHERE state <> 'F' AND ts <= DATE '2001-12-01'
 UNION ALL SELECT 'open_accounts', CAST(count(*) AS DOUBLE) FROM acc WHERE state = 'O'
 UNION ALL SELECT 'total_balance', CAST(sum(balance) AS DOUBLE) FROM acc
 UNION ALL SELECT 'clients', CAST(count(*) AS DOUBLE) FROM cli""",
    "year_month": f"""{STAR} SELECT year(ts) AS year, month(ts) AS month, type, count(*) AS tx_count,
 CAST(sum(tx.amount) AS DOUBLE) AS amount FROM tx GROUP BY 1, 2, 3""",
    "heavy_months": f"""{STAR} SELECT client_id, year(ts) AS year, month(ts) AS month,
 count(*) AS tx_count, CAST(sum(tx.amount) AS DOUBLE) AS amount
 FROM tx JOIN acc USING (account_id) GROUP BY 1, 2, 3
 HAVING count(*) >= 5 AND sum(tx.amount) > 100000""",
    "frequent_large": f"""{STAR} SELECT client_id, name, segment, count(*) AS tx_count,
 CAST(sum(tx.amount) AS DOUBLE) AS amount FROM tx JOIN acc USING (account_id)
 JOIN cli USING (client_id) WHERE tx.amount > 40000 GROUP BY 1, 2, 3 HAVING count(*) > 5""",
    "clients_over": f"""{_ACTIVITY} SELECT client_id, name, segment, accounts,
 CAST(balance AS DOUBLE) AS balance, last_opened FROM cli JOIN bal USING (client_id)
 WHERE bal.balance > 2000000""",
    "annual_report": f"""{STAR} SELECT client_id, name, coalesce(tx_count, 0) AS tx_count,
 CAST(coalesce(amount, 0) AS DOUBLE) AS amount FROM cli LEFT JOIN (SELECT client_id,
 count(*) AS tx_count, sum(amount) AS amount FROM tx JOIN acc USING (account_id)
 WHERE ts >= DATE '1998-01-01' AND ts < DATE '1999-01-01' GROUP BY client_id) USING (client_id)""",
    "find_transactions": f"""{STAR} SELECT account_id, CAST(line AS BIGINT) AS line, part_id,
 supplier_id, type, state, CAST(amount AS DOUBLE) AS amount, ts FROM tx
 WHERE ts >= DATE '1997-01-01' AND ts < DATE '1998-01-01' AND type = 'R' AND tx.amount >= 30000""",
}

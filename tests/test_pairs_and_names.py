from decimal import Decimal

from ledgerloom.operators import matching, normalize, report
from ledgerloom.plans.model import KIND_NAMES, KINDS, ROLE_NAMES, SCENARIOS, SEMANTIC_NAMES, SEMANTICS, Rule, Session, Source
from pyspark.sql import functions as F


def test_pair_amounts_are_fail_closed(spark):
    session = SCENARIOS["scenario_ledger112_bank_statement"].session("s", (Source("b", "ledger112", role="PRIMARY"), Source("k", "bank_statement")))
    rows = [(1, Decimal(5), None, None, Decimal(5)), (2, Decimal(5), None, Decimal(5), None), (3, None, None, None, Decimal(5)), (4, None, Decimal(7), Decimal(7), None)]
    pairs = spark.createDataFrame(rows, "n int, p_debit_amount decimal(28,6), p_credit_amount decimal(28,6), s_debit_amount decimal(28,6), s_credit_amount decimal(28,6)")
    got = matching.pair_amounts(session, pairs, "ledger112", "bank_statement").collect()
    assert [(r.n, r.primary_amount, r.secondary_amount, r.semantic, r.days) for r in got] == [(1, 5, 5, "BANK_PAYMENT", 3), (4, 7, 7, "BANK_PAYMENT", 3)]
    assert {r.semantic_name for r in got} == {"DÒNG TIỀN / SAO KÊ"}
    assert matching.pair_amounts(session, pairs, "ledger112", "cash_book").collect() == []
    odd = Session("s", session.sources, (Rule("r", "CUSTOM", "ledger112", "noSuchAmount", "bank_statement", "creditAmount"),))
    assert matching.pair_amounts(odd, pairs, "ledger112", "bank_statement").collect() == []


def test_everything_has_a_name(spark):
    assert set(KIND_NAMES) == set(KINDS) and set(SEMANTIC_NAMES) == set(SEMANTICS) and set(ROLE_NAMES) == {"PRIMARY", "SECONDARY", "OPTIONAL", "REFERENCE"}
    df = spark.createDataFrame([("ledger112",), ("odd",)], "kind string")
    assert [r[0] for r in df.select(report.named(F.col("kind"), KIND_NAMES)).collect()] == ["Sổ cái TK 112 (Tiền gửi ngân hàng)", "odd"]


def test_classes_of_transfers_hold_all_pairs(spark):
    rows = [(f"r{i}", f"acc{i % 3}", Decimal(100 * (1 + i % 2)) if i % 4 < 2 else None, Decimal(100 * (1 + i % 2)) if i % 4 >= 2 else None) for i in range(60)] + [("blank", " ", Decimal(100), None), ("none", "acc1", None, None)]
    df = spark.createDataFrame(rows, "id string, bank_account string, debit_amount decimal(18,2), credit_amount decimal(18,2)")
    pairs = sorted((r.a_id, r.b_id, r.amount) for r in normalize.internal_transfers(df, df).collect())
    links, members = normalize.transfer_classes(df, df)
    of = {}
    for m in members.collect():
        of.setdefault((m.side, m.amount, m.account, m.credit), []).append(m.id)
    found = links.collect()
    assert sum(r.links for r in found) == len(pairs) > 500
    spread = [(a, b, r.amount) for r in found for a in of["a", r.amount, r.a_account, r.a_credit] for b in of["b", r.amount, r.b_account, not r.a_credit]]
    assert sorted(spread) == pairs

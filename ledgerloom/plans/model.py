"""Declarations: record schema, sources, rules, sessions, the built-in scenarios, and display names."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

MONEY = "decimal(28,6)"
TEXT_FIELDS = ("date", "doc_no", "doc_code", "series", "template_code", "partner_tax_id", "buyer_tax_id", "seller_tax_id", "partner_name", "partner_code", "vat_rate", "debit_account", "credit_account", "voucher_no", "description", "bank_account", "transaction_number", "accounting_date", "transaction_date", "counterparty_account", "counterparty_name")
MONEY_FIELDS = ("pretax_amount", "vat_amount", "discount_amount", "fee_amount", "total_amount", "debit_amount", "credit_amount", "balance")
#: The canonical record: pos is its order inside its source.
RECORD_SCHEMA = ", ".join(["id string", "source_id string", "source_row int", "pos bigint", *[f"{c} string" for c in TEXT_FIELDS], *[f"{c} {MONEY}" for c in MONEY_FIELDS], "total_amount_origin string", "raw_fields map<string,string>"])

# Kinds of sources, semantics and statuses, as they appear in data.
KINDS = ("e_invoice", "ledger511", "ledger3331", "ledger131", "ledger133", "ledger112", "bank_statement", "partner_master", "sales_register", "sales_analysis_report", "cash_book", "branch_ledger", "custom")
SEMANTICS = ("REVENUE", "VAT", "RECEIVABLE", "BANK_PAYMENT", "CUSTOM")
# What kinds, roles and semantics are called in reports.
KIND_NAMES = {
    "e_invoice": "Hóa đơn điện tử", "ledger511": "Sổ cái TK 511 (Doanh thu)", "ledger3331": "Sổ cái TK 3331 (Thuế GTGT)", "ledger133": "Sổ cái TK 133 (Thuế đầu vào)", "ledger131": "Sổ công nợ TK 131 (Phải thu)",
    "ledger112": "Sổ cái TK 112 (Tiền gửi ngân hàng)", "partner_master": "Danh mục khách hàng / nhà cung cấp", "sales_register": "Bảng kê bán hàng", "sales_analysis_report": "Báo cáo phân tích bán hàng",
    "bank_statement": "Sao kê ngân hàng", "cash_book": "Sổ quỹ tiền mặt", "branch_ledger": "Sổ chi nhánh", "custom": "Khác / Tùy chỉnh (Cần xác định)",
}
ROLE_NAMES = {"PRIMARY": "Nguồn chính (PRIMARY)", "SECONDARY": "Nguồn bắt buộc (REQUIRED)", "OPTIONAL": "Nguồn bổ trợ (OPTIONAL)", "REFERENCE": "Danh mục tham chiếu (REFERENCE MASTER)"}
SEMANTIC_NAMES = {"REVENUE": "DOANH THU", "VAT": "THUẾ GTGT", "RECEIVABLE": "CÔNG NỢ (PHẢI THU)", "BANK_PAYMENT": "DÒNG TIỀN / SAO KÊ", "CUSTOM": "ĐỐI CHIẾU KHÁC"}
ACCEPTED = ("MATCHED_EXACT", "MATCHED_WITH_TOLERANCE", "MATCHED_AGGREGATE", "MATCHED_WITH_MISSING_SOURCE")
STATUSES = (*ACCEPTED, "MISMATCH_AMOUNT", "MISMATCH_METADATA", "UNMATCHED_MISSING_IN_TARGET", "UNMATCHED_MISSING_IN_SOURCE", "DUPLICATE_SUSPECT", "AMBIGUOUS_MATCH", "NEEDS_REVIEW", "NOT_CHECKED")
BANKING = ("ledger112", "bank_statement")
#: Candidate sets beyond this are never searched for sums.
MAX_SUBSET = 12
#: Days that candidates may lie beyond the rule's window and still be looked at.
SLACK_DAYS = 15

_FIELDS = {"pretaxAmount": "pretax_amount", "vatAmount": "vat_amount", "totalAmount": "total_amount", "debitAmount": "debit_amount", "creditAmount": "credit_amount", "directionalAmount": "directional_amount"}
#: Rule field, in camel or snake case, to the record's column.
RULE_FIELDS = _FIELDS | {v: v for v in _FIELDS.values()}


class ReconciliationError(ValueError):
    """A session that can't be run; code is stable."""

    def __init__(self, code: str, text: str):
        super().__init__(f"{code}: {text}")
        self.code = code


@dataclass(frozen=True)
class Source:
    id: str
    kind: str
    name: str = ""
    role: str = "SECONDARY"
    sheet: str = ""
    path: str = ""
    header_row: int = 1
    data_start_row: int = 2
    mapping: dict[str, str] = field(default_factory=dict)
    raw_hash: str = ""

    @property
    def title(self) -> str:
        return self.name or self.id


@dataclass(frozen=True)
class Rule:
    id: str
    semantic: str
    primary_kind: str
    primary_field: str
    secondary_kind: str
    secondary_field: str
    tolerance: float | str = 0
    days: int = 0
    name: str = ""


@dataclass(frozen=True)
class Session:
    id: str
    sources: tuple[Source, ...]
    rules: tuple[Rule, ...] = ()
    scenario: str = ""
    primary_id: str | None = None
    expected_primary_kind: str | None = None
    required_ids: tuple[str, ...] | None = None
    required_kinds: tuple[str, ...] = ()
    tolerance: float | str = 0
    days: int = 0
    aggregate: bool = False

    def source(self, source_id: str) -> Source:
        return next(s for s in self.sources if s.id == source_id)

    def primary(self) -> Source:
        """The named one, else by role, else an invoice source, else the first; its kind is checked."""
        if len(self.sources) < 2:
            raise ReconciliationError("TOO_FEW_SOURCES", "two sources are needed")
        picks = ([s for s in self.sources if s.id == self.primary_id], [s for s in self.sources if s.role == "PRIMARY"], [s for s in self.sources if s.kind == "e_invoice"], list(self.sources))
        if self.primary_id and not picks[0]:
            raise ReconciliationError("PRIMARY_NOT_FOUND", self.primary_id)
        found = next(p[0] for p in picks if p)
        if self.expected_primary_kind and found.kind != self.expected_primary_kind:
            raise ReconciliationError("PRIMARY_KIND", f"{found.kind} where {self.expected_primary_kind} is expected")
        return found

    def secondaries(self) -> list[Source]:
        p = self.primary()
        return [s for s in self.sources if s.id != p.id]

    def is_required(self, s: Source) -> bool:
        return s.id in self.required_ids if self.required_ids is not None else s.role != "OPTIONAL"

    def check(self) -> None:
        have = {s.kind for s in self.secondaries()} | {s.id for s in self.secondaries()}
        lacking = [x for x in (*self.required_kinds, *(self.required_ids or ())) if x not in have and x != self.primary().id]
        if lacking:
            raise ReconciliationError("REQUIRED_SOURCE_MISSING", ", ".join(lacking))

    def controls(self) -> list[Control]:
        """Every rule of each source's kinds, in source order; a source without one gets a control without a rule."""
        p, out = self.primary(), []
        for i, s in enumerate(self.secondaries()):
            rules = [r for r in self.rules if (r.primary_kind, r.secondary_kind) == (p.kind, s.kind)]
            out += [Control(len(out) + k, i, s, r, self) for k, r in enumerate(rules or [None])]
        return out

    @property
    def is_tri_source(self) -> bool:
        return {s.kind for s in self.sources} >= {"e_invoice", "sales_register", "ledger511"}


@dataclass(frozen=True)
class Control:
    """A rule compiled for one secondary source."""

    order: int
    source_order: int
    source: Source
    rule: Rule | None
    session: Session

    @property
    def tolerance(self) -> str:
        return str((self.rule.tolerance if self.rule and float(self.rule.tolerance) else 0) or self.session.tolerance)

    @property
    def days(self) -> int:
        return int((self.rule.days if self.rule else 0) or self.session.days)

    @property
    def is_bank(self) -> bool:
        return self.session.primary().kind == "ledger112" and self.source.kind == "bank_statement"


@dataclass(frozen=True)
class Scenario:
    """Parameters of a built-in reconciliation: rules as (semantic, primary field, secondary kind, secondary field)."""

    id: str
    primary_kind: str
    rules: tuple[tuple[str, str, str, str], ...] = ()
    optional_kinds: tuple[str, ...] = ()
    tolerance: int = 0
    days: int = 0
    aggregate: bool = False

    def session(self, session_id: str, sources: tuple[Source, ...], **changes) -> Session:
        rules = tuple(Rule(f"{self.id}_{i + 1}", s, self.primary_kind, p, k, f, self.tolerance, self.days) for i, (s, p, k, f) in enumerate(self.rules))
        kinds = {k for _, _, k, _ in self.rules} - set(self.optional_kinds)
        required = tuple(s.id for s in sources if s.kind in kinds) if rules else None
        made = Session(session_id, sources, rules, self.id, None, None if self.primary_kind == "any" else self.primary_kind, required, (), self.tolerance, self.days, self.aggregate)
        return replace(made, **changes)


_REGISTER = (("REVENUE", "pretaxAmount", "sales_register", "pretaxAmount"), ("VAT", "vatAmount", "sales_register", "vatAmount"), ("RECEIVABLE", "totalAmount", "sales_register", "totalAmount"))
_REVENUE = (("REVENUE", "pretaxAmount", "ledger511", "creditAmount"),)
SCENARIOS: dict[str, Scenario] = {
    s.id: s
    for s in (
        Scenario("scenario_revenue_standard", "e_invoice", _REVENUE, (), 10, 3, True),
        Scenario("scenario_revenue_vat_receivables", "e_invoice", (*_REVENUE, ("VAT", "vatAmount", "ledger3331", "creditAmount"), ("RECEIVABLE", "totalAmount", "ledger131", "debitAmount")), ("ledger131",), 10, 3, True),
        Scenario("scenario_input_vat", "e_invoice", (("VAT", "vatAmount", "ledger133", "debitAmount"),), (), 10, 3, True),
        Scenario("scenario_bank_reconciliation", "ledger131", (("BANK_PAYMENT", "creditAmount", "bank_statement", "creditAmount"),), (), 0, 3),
        Scenario("scenario_invoice_sales_register", "e_invoice", _REGISTER, (), 0, 3),
        Scenario("scenario_invoice_sales_register_ledger511", "e_invoice", (*_REGISTER, *_REVENUE), (), 0, 3),
        Scenario("scenario_ledger112_bank_statement", "ledger112", (("BANK_PAYMENT", "directionalAmount", "bank_statement", "directionalAmount"),), (), 0, 3),
        Scenario("scenario_partner_identity_control", "partner_master"),
        Scenario("scenario_sales_analysis_report_control", "sales_analysis_report"),
        Scenario("scenario_custom_multi_source", "any", (), (), 10, 3, True),
    )
}

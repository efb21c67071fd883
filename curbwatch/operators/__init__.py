from .documents import (
    fine_document_fragments,
    fine_report_document,
    fine_report_response,
    master_document_fragments,
    master_report_document,
    save_document,
    saved_document,
)
from .fine_report import (
    fine_counts,
    fine_counts_by,
    fine_counts_from_report,
    fine_counts_from_rows,
    fine_report,
    fine_report_rows,
    fine_rows_from,
    sector_counts,
)
from .master_report import (
    explode_distribution,
    master_counts_by,
    master_partials,
    master_report,
    master_report_rows,
    master_rows_from,
    master_scalars,
    section_rows,
)
from ..functions.codes import KINDS
from .metrics import (
    drop_reason_distribution,
    manual_review_count,
    sector_fine_distribution,
    sectors_count,
    transaction_count,
    transaction_type_distribution,
)

__all__ = [
    "KINDS",
    "drop_reason_distribution",
    "explode_distribution",
    "fine_document_fragments",
    "fine_counts",
    "fine_counts_by",
    "fine_counts_from_report",
    "fine_counts_from_rows",
    "fine_report",
    "fine_report_document",
    "fine_report_response",
    "fine_report_rows",
    "fine_rows_from",
    "manual_review_count",
    "master_counts_by",
    "master_document_fragments",
    "master_partials",
    "master_report",
    "master_report_document",
    "master_report_rows",
    "master_rows_from",
    "master_scalars",
    "save_document",
    "saved_document",
    "sector_counts",
    "section_rows",
    "sector_fine_distribution",
    "sectors_count",
    "transaction_count",
    "transaction_type_distribution",
]

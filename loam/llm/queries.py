"""The registry of this subpackage's queries: name -> (function of (spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

from loam.llm import bpe, leak, markup, mojibake, neardup, ocr, pagediff, residue

REGISTRY = {
    "p2_found": (neardup.p2_found, None),
    "p2_classes": (neardup.p2_classes, None),
    "p2_groups": (neardup.p2_groups, None),
    "p3_found": (mojibake.p3_found, None),
    "p3_restored": (mojibake.p3_restored, None),
    "p5_found": (ocr.p5_found, None),
    "p5_repaired": (ocr.p5_repaired, None),
    "p6_found": (markup.p6_found, None),
    "p6_plain": (markup.p6_plain, None),
    "p6_differenced": (pagediff.p6_differenced, None),
    "p8_ids": (bpe.p8_ids, None),
    "p9_found": (leak.p9_found, leak.P9_SQL),
    "p9_spans": (leak.p9_spans, None),
    "p10_found": (residue.p10_found, None),
    "p10_kept": (residue.p10_kept, None),
}

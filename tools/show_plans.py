"""Write PLANS.md: the formatted physical plans of the headline reports over
a stored parquet detections collection.

Usage: python tools/show_plans.py [sf_dir] [out.md]
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

MAX_LINE = 240


def main(argv: list[str]) -> int:
    from curbwatch.operators import fine_counts, fine_report_document, master_report_document, sector_counts
    from curbwatch.plans import exchanges_after_partial_aggregates, plan_text, pushed_filters, read_schemas
    from curbwatch.schema import DETECTIONS_SCHEMA
    from curbwatch.session import local_session, shared_dir
    from curbwatch.sources import CollectionRegistry, load_detections

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    out = argv[1] if len(argv) > 1 else os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    spark = local_session(8, checkpoint_dir=tempfile.mkdtemp(prefix="curbwatch-plans-"))
    stored = shared_dir(spark, "plans_collection")
    load_detections(spark, sf_dir).write.parquet(stored)
    detections = CollectionRegistry(spark).add("DETECTIONS", DETECTIONS_SCHEMA, path=stored)

    cases = [
        ("fine counts", fine_counts(detections)),
        ("rows per sector", sector_counts(detections)),
        ("fine report document", fine_report_document(detections)),
        ("master report document, no filter", master_report_document(detections)),
        (
            'master report document, filter {"SECTOR_NAME": "SECTOR_3", "TYPE": {"$in": [1, 5, 6]}}',
            master_report_document(detections, {"SECTOR_NAME": "SECTOR_3", "TYPE": {"$in": [1, 5, 6]}}),
        ),
    ]
    lines = [
        "# Physical plans of the headline reports",
        "",
        "Generated by `python tools/show_plans.py` over the detections derived from",
        "`events`, stored as parquet and registered with the declared 40-column schema.",
        f"Long lines are cut at {MAX_LINE} characters.",
        "",
    ]
    for title, df in cases:
        lines += [
            f"## {title}",
            "",
            f"- ReadSchema: `{'`, `'.join(read_schemas(df))}`",
            f"- PushedFilters: {', '.join(f'`{p}`' for p in pushed_filters(df) if p.strip('[] ')) or 'none'}",
            f"- every exchange fed by a partial aggregate: {exchanges_after_partial_aggregates(df)}",
            "- final adaptive plan after one run (`[codegen id : n]` marks whole-stage codegen):",
            "",
            "```",
        ]
        df.collect()
        # the plan that ran, without the tree of the first one
        final = re.sub(r"\+- == Initial Plan ==\n(?:.+\n)*", "", plan_text(df))
        for line in final.replace(stored, "<collection>").rstrip().splitlines():
            lines.append(line if len(line) <= MAX_LINE else line[:MAX_LINE] + " ...")
        lines += ["```", ""]
    with open(out, "w") as fh:
        fh.write("\n".join(lines))
    print(out)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

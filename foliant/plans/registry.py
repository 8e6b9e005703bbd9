"""Every registered query of the reference's own operators, and its oracle."""

from __future__ import annotations

from foliant.plans import activity_queries, alignment_queries, biblio_queries, build_queries, claim_queries, corpus_queries, finding_queries, grammar_queries, loader_queries, parse_queries, readiness_queries, report_queries, review_queries

MODULES = [parse_queries, claim_queries, corpus_queries, activity_queries, review_queries, biblio_queries, loader_queries, report_queries, finding_queries, grammar_queries, readiness_queries, alignment_queries, build_queries]
#: Early forms that read a part of their input; the queries of the same name with _whole, or _full, take their place.
PARTIAL = {
    "p7_fingerprint", "p8_overall", "p9_source_rows", "j12_flag_sources", "p10_source_types", "j1_aligned_flags", "a1_match_rate", "j5_sources_in_references", "q2_review_similarity", "p13_badge_style", "p14_badges", "j13_nearest_sentences",
    "l5_venue_ranking", "l6_field_guess", "a6_readiness_scores", "l7_breakdown",
}
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items() if k not in PARTIAL}
ORACLES: dict = {k: v for m in MODULES for k, v in m.ORACLES.items() if k not in PARTIAL}

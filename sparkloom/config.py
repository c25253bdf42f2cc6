"""Every tunable of the engine, with the checks that keep it sound."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Limits, weights and thresholds.  Fixed values of the data model and of the published behaviour."""

    search_limit: int = 15
    fuzzy_limit: int = 10
    related_limit: int = 20
    max_hops: int = 3
    max_depth: int = 5
    max_path: int = 10
    path_results: int = 10
    related_shown: int = 10
    usages_shown: int = 5
    exclude_file_buffer: int = 5
    max_vector_results: int = 20
    graph_weight: float = 0.5
    vector_weight: float = 0.5
    centrality_weight: float = 0.2
    context_weight: float = 0.1
    entity_bonus: float = 0.3
    relationship_bonus: float = 0.15
    quality_weight: float = 0.1
    centrality_norm: int = 50
    min_depth_score: float = 0.3
    depth_decay: float = 0.2
    partial_match: float = 0.5
    per_file: int = 5
    total: int = 50
    rerank_graph: float = 0.4
    rerank_vector: float = 0.6
    rerank_per_file: int = 3
    merge_bonus: float = 1.1
    chunk_tokens: int = 1000
    chunk_overlap: int = 200
    excerpt_chars: int = 500
    preview_chars: int = 300
    drift_doc_chars: int = 3000
    drift_code_chars: int = 4000
    default_drift_score: float = 0.5
    links_per_chunk: int = 15
    link_candidates: int = 20

    def __post_init__(self) -> None:
        for f in fields(self):
            v = getattr(self, f.name)
            if v < 0 or f.type == "int" and v < 1:
                raise ValueError(f"{f.name} must be positive, not {v}")
        if self.chunk_overlap >= self.chunk_tokens:
            raise ValueError("the overlap must be smaller than the chunk")


SETTINGS = Settings()

#: Graph and vector weight by the intent of a question; other intents keep the defaults.  Fixed values.
INTENT_WEIGHTS = {
    "find_callers": (0.8, 0.2), "find_callees": (0.8, 0.2), "find_call_chain": (0.9, 0.1), "find_hierarchy": (0.85, 0.15), "find_usages": (0.7, 0.3), "find_dependencies": (0.75, 0.25), "locate_entity": (0.6, 0.4),
    "locate_file": (0.5, 0.5), "explain_implementation": (0.5, 0.5), "explain_relationship": (0.6, 0.4), "explain_data_flow": (0.65, 0.35), "find_similar": (0.2, 0.8), "search_functionality": (0.3, 0.7), "search_pattern": (0.25, 0.75),
}
#: Kind of search by intent; the rest are hybrid.  Fixed values.
GRAPH_INTENTS = ("find_callers", "find_callees", "find_call_chain", "find_hierarchy", "find_usages", "find_dependencies", "find_dependents", "locate_entity", "locate_file")
VECTOR_INTENTS = ("find_similar", "search_functionality", "search_pattern")
#: Values that status columns may hold.  Fixed values.
STATUSES = {"drift_status": ("unknown", "aligned", "minor_drift", "major_drift"), "link_type": ("explicit", "implicit"), "drift_severity": ("none", "minor", "major", "aligned", "minor_drift", "major_drift", "unknown")}
DRIFTED = ("minor_drift", "major_drift")

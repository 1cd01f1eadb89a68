"""Declared schemas; nothing is inferred."""

TRAIN = "id string, question string, question_decomposition array<struct<id:long,question:string,answer:string>>, answer string, hop_count long"
ITEM = "id string, question string, question_decomposition array<struct<id:long,question:string,answer:string>>, answer string, answer_aliases array<string>, answerable boolean, paragraphs array<struct<idx:long,title:string,paragraph_text:string,is_supporting:boolean>>, hop_count long"
GOLD = "id string, hop_count long, question string, question_decomposition array<struct<id:long,question:string>>, index long"
MASKED = "id string, question string, index long, question_masked_typed string, question_masked_uniform string"
SAMPLE = "id string, index long, question string"
PREDICTION = "query_id string, question string, hop_count long, decomposition string, few_shot_source string"
ROUTER = "query_id string, predicted_hop long, expected_hop long, correct boolean, parse_fallback boolean"
ROUTER_DETAIL = "question string, expected long, predicted long, correct boolean"
EXECUTION = "question string, hop_count long, decomposition string, ops array<string>, kg_results array<string>, error_reason string"
POOL_ITEM = "struct<question:string,masked:string,decomposition:string,hop_count:long>"


def enriched(dataset: str) -> str:
    """Masked questions with the decomposition of their example, in a field that ends in the dataset's name."""
    return f"{MASKED}, few_shot_decomposition_{dataset} array<string>"


def retrieval(dataset: str) -> str:
    """Neighbours of each query in three modes, with their decompositions in such a field."""
    own = "pool_id:string,pool_index:long,pool_question:string,pool_question_masked_typed:string,pool_question_masked_uniform:string"
    lists = ", ".join(f"{mode}_top_k array<struct<{own},pool_few_shot_decomposition_{dataset}:array<string>,score:double>>" for mode in ("raw", "typed", "uniform"))
    return f"query_id string, query_index long, query_question string, query_question_masked_typed string, query_question_masked_uniform string, {lists}"

"""Term lists and other fixed values the scores are defined by.

Everything in the first part of this file is a FIXED VALUE: results only come
out right with exactly these words and numbers.  The second part groups them
into a :class:`Vocabulary`, which a caller may replace list by list (see
``Vocabulary.with_terms_table``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, replace

# --------------------------------------------------------------------------
# Fixed values
# --------------------------------------------------------------------------

HUBS = (
    "pune", "noida", "delhi ncr", "delhi", "new delhi", "gurgaon",
    "gurugram", "faridabad", "hyderabad", "mumbai", "bangalore", "bengaluru",
)
HOME_COUNTRY = ("india", "in")
RELOCATION_EXEMPT = ("pune", "noida")

SERVICE_FIRMS = (
    "tcs", "infosys", "wipro", "accenture", "cognizant", "capgemini",
    "hcl", "hcltech", "tech mahindra", "mphasis", "mindtree", "l&t infotech",
    "ltimindtree", "hexaware", "niit technologies", "zensar", "persistent",
    "cyient", "kpit", "birlasoft",
)

IR_BASE = (
    "retrieval", "ranking", "embeddings", "embedding", "vector search",
    "matching systems", "recommendation", "recommendations", "recommend",
    "milvus", "pinecone", "qdrant", "weaviate", "faiss", "elasticsearch",
    "opensearch", "ndcg", "mrr", "map", "learning-to-rank", "ltr",
    "ann", "approximate nearest neighbor", "hybrid retrieval",
    "bm25", "dense retrieval", "sparse retrieval", "reranking", "re-ranking",
    "rerank", "semantic search", "vector database", "vector db", "vectordb",
    "information retrieval", "search engine", "search quality",
    "candidate matching", "job matching", "talent matching",
    "matching engine", "entity matching", "profile matching",
    "owned ranking", "ranking strategy", "ranking roadmap",
    "ranking quality", "retrieval quality", "ranking owner",
    "candidate generation", "relevance optimization", "relevance pipeline",
    "marketplace matching", "matching marketplace platform",
    "sentence-transformers", "sentence transformers", "bi-encoder",
    "cross-encoder", "colbert", "dpr", "ance", "splade",
    "recall optimization", "precision recall", "search relevance",
    "query understanding", "query expansion", "bge", "e5 model",
    "chroma", "pgvector",
)
RECOMMENDER = (
    "recommendation engine", "recommender", "collaborative filtering",
    "matrix factorization", "personalization", "feed ranking",
    "content ranking", "candidate recommendation", "item ranking",
    "personalized feed", "matching marketplace", "candidate discovery",
    "content recommendations", "user-item scoring",
)
LEARNING_TO_RANK = (
    "learning-to-rank", "learning to rank", "ltr", "lambdamart",
    "lightgbm ranker", "ranknet", "listnet", "xgboost ranking",
    "xgboost ranker", "catboost ranking", "gradient boosted ranking",
)

BUILDER_VERBS = (
    "shipped", "built", "build", "designed", "implemented", "deployed",
    "architected", "productionized", "created", "developed", "wrote",
    "established", "launched", "delivered", "authored", "constructed",
    "engineered", "coded", "programmed", "released", "published",
)
LEADER_VERBS = (
    "led", "drove", "owned", "managed", "directed", "oversaw",
    "supervised", "spearheaded", "championed", "initiated", "coordinated",
    "mentored", "scaled",
)
PASSIVE_VERBS = (
    "contributed", "supported", "assisted", "researched", "investigated",
    "helped", "participated", "involved", "worked on", "collaborated",
)
OWNERSHIP_WORDS = (
    "architected", "drove", "owned", "scaled", "spearheaded",
    "designed", "established", "launched", "led",
)
OWNERSHIP_VERBS = ("architected", "drove", "owned", "designed", "led", "shipped")

GENAI = (
    "langchain", "llamaindex", "llama_index", "openai api", "chatgpt api",
    "gpt-4 api", "gpt4 api", "rag pipeline", "rag application",
    "langsmith", "flowise", "haystack", "promptflow",
)
BUSINESS_METRICS = (
    "ctr", "click-through", "click through", "conversion",
    "engagement lift", "search success", "revenue", "retention",
    "bounce rate", "active users",
)
EMBEDDING_OPS = (
    "drift", "index refresh", "re-indexing", "reindexing",
    "retrieval quality", "retrieval regression", "embedding monitoring",
    "vector refresh", "index rebuild",
)
DISCLAIMERS = (
    "was handled by", "handled by the platform team", "handled by another team",
    "deployment was handled", "someone else deployed", "platform team deployed",
    "not my responsibility", "wasn't my role", "was not my role",
    "secondary", "my role was more on the modeling side",
    "my own modeling work was secondary",
    "worked with a team that", "as part of a team that", "alongside a team that",
    "team that built", "team that designed", "team that owned",
)
ML_DISCLAIMERS = (
    "wouldn't call myself", "would not call myself", "not an ml specialist",
    "not a specialist", "lightweight ml", "comfortable with the modeling work but",
)
VECTOR_OR_EVAL = (
    "milvus", "pinecone", "qdrant", "weaviate", "faiss", "chroma",
    "opensearch", "elasticsearch", "pgvector", "ndcg", "mrr", "map",
    "a/b test", "ab test", "offline eval", "online eval",
    "evaluation framework", "ranking evaluation", "retrieval eval",
)

CODING_TITLES = (
    "software engineer", "software developer", "ml engineer",
    "machine learning engineer", "ai engineer", "data engineer",
    "data scientist", "backend engineer", "frontend engineer",
    "full stack", "fullstack", "platform engineer", "sde", "swe",
    "research engineer", "applied scientist", "nlp engineer",
    "computer vision", "deep learning", "ai researcher",
    "site reliability", "sre", "cloud engineer", "recommendation",
    "search engineer", "ranking engineer", "retrieval engineer",
    "distributed systems", "mlops",
)
LEAD_TITLES = ("lead", "manager", "architect", "head", "director", "vp", "principal", "staff")
# Highest tier is tested first; a title with none of these words is tier 2.
TITLE_TIERS = (
    (5, ("director", "head", "vp", "vice president", "cto", "cpo")),
    (4, ("staff", "principal", "architect", "distinguished")),
    (3, ("senior", "lead", "tech lead", "team lead", "principal engineer")),
    (2, ("engineer", "developer", "data scientist", "analyst", "designer",
         "programmer", "consultant", "specialist")),
    (1, ("junior", "associate", "intern", "trainee")),
)
DEFAULT_TIER = 2
ML_ROLE = (
    "machine learning", "ai ", "nlp", "data scientist",
    "deep learning", "llm", "gen ai", "generative",
)
RESEARCH = (
    "research", "lab", "laboratory", "academia",
    "phd candidate", "postdoc", "university", "institute",
)
RESEARCH_PRODUCTION = (
    "production", "deployed", "shipped", "users",
    "product", "startup", "company", "clients",
)

RESCUE_TERMS = (
    "ranking", "retrieval", "search engine",
    "matching system", "candidate matching", "job matching",
    "talent matching", "matching engine", "entity matching", "profile matching",
    "dual-tower", "dual tower", "two-tower", "two tower",
    "candidate generation", "relevance optimization", "relevance pipeline",
    "marketplace matching",
)
STRONG_TERMS = (
    "ranking system", "search system", "recommendation system",
    "matching system", "retrieval system", "ranking model",
    "semantic search", "candidate ranking", "search relevance",
    "candidate matching", "job matching", "talent matching",
    "matching engine", "entity matching", "profile matching",
    "dual-tower", "dual tower", "two-tower", "two tower",
    "owned ranking", "ranking strategy", "ranking roadmap",
    "ranking quality", "retrieval quality", "ranking owner",
    "owns ranking", "own the ranking",
    "candidate generation", "relevance optimization", "relevance pipeline",
    "marketplace matching", "matching marketplace platform",
    "owned retrieval", "retrieval strategy", "retrieval owner",
    "owns retrieval", "own the retrieval",
    "ranking layer", "search and discovery", "discovery experience",
    "owned the search", "designed the search",
)
MEDIUM_TERMS = ("embeddings", "vector search", "relevance")
DEPLOY = ("production", "deployed", "inference")
DEPLOY_OR_SHIPPED = ("production", "deployed", "inference", "shipped")
RELEVANCE_EVAL = ("ndcg", "mrr", "a/b test", "ab test", "offline eval")
FORMAL_EVAL = ("ndcg", "mrr", "a/b test", "ab test")

PRODUCTION_TERMS = (
    "production", "deployed", "deployment", "inference", "serving",
    "latency", "throughput", "drift", "monitoring", "model drift",
    "a/b test", "canary", "shadow mode",
)
PRE_LLM = (
    "xgboost", "lightgbm", "sklearn", "scikit-learn", "random forest",
    "gradient boosting", "svm", "logistic regression",
    "collaborative filtering", "matrix factorization", "word2vec",
    "fasttext", "bert", "roberta", "sentence-bert",
)
SKIPPED_TITLES = (
    "hr manager", "accountant", "graphic designer", "content writer",
    "sales executive", "business analyst", "project manager",
    "operations manager", "marketing manager", "civil engineer",
    "mechanical engineer", "customer support", "customer success",
    "recruiter", "talent acquisition", "office manager", "executive assistant",
)
ML_CONTEXT = (
    "model", "ml", "machine learning", "neural", "prediction",
    "ranking", "retrieval", "recommendation", "embedding",
    "classifier", "regression", "training", "inference pipeline",
)
BUILD_WORDS = (
    "built", "build", "shipped", "deployed", "owned", "designed",
    "architected", "implemented", "developed", "created",
    "launched", "established",
)
EARLY_ML = ("ml", "model", "machine learning", "neural", "prediction")
EVAL_TERMS = (
    "ndcg", "mrr", "map", "mean average precision",
    "a/b test", "ab test", "online experiment", "offline eval",
    "evaluation framework", "ranking eval", "precision@", "recall@",
    "click-through rate", "ctr", "engagement metric",
    "relevance judgment", "human eval", "annotation",
    "offline-online correlation", "offline to online correlation",
    "offline metrics", "correlated with online", "offline-to-online",
    "evaluation methodology", "eval methodology",
)
PLATFORM_TERMS = ("platform", "system", "infrastructure", "pipeline")
ARCHITECTURE = (
    "ann", "approximate nearest neighbor", "hnsw", "ivf",
    "hybrid retrieval", "hybrid search", "dense-sparse", "bm25",
    "recall optimization", "inverted index", "sharding",
    "query latency", "p99", "vector index",
)
ARCHITECTURE_OWNED = (
    "architected", "designed", "built", "owned",
    "implemented", "optimized", "tuned",
)
ARCHITECTURE_LIVE = ("production", "deployed", "serving", "scale")
STARTUP_SIZES = ("1-10", "11-50", "51-200")
FOUNDING_SIZES = ("1-10", "11-50")
PRODUCT_INDUSTRIES = (
    "software", "saas", "fintech", "edtech", "healthtech",
    "ecommerce", "marketplace", "ai", "transportation", "food delivery",
    "gaming", "media", "entertainment", "telecom",
)
SCALE_TERMS = (
    "tb", "terabyte", "petabyte", "billion", "million users",
    "100ms", "<100", "p99", "latency", "qps", "queries per second",
    "high throughput", "large scale", "at scale",
)
VECTOR_STORES = ("milvus", "pinecone", "qdrant", "weaviate", "faiss", "pgvector")
FOUNDING = (
    "seed", "series a", "series b", "startup", "0 to 1", "zero to one",
    "founding", "ground up", "greenfield", "mvp", "prototype",
    "ambiguity", "fast-paced", "early stage", "from scratch",
)
PYTHON_TOOLS = (
    "python", "pyspark", "fastapi", "flask", "django",
    "asyncio", "multiprocessing", "pytest", "poetry", "pipenv",
)
PYTHON_DEPTH = (
    "system design", "architecture", "microservice", "backend",
    "api design", "performance optimization", "profiling", "celery",
)
DISTRIBUTED = (
    "distributed", "kafka", "spark", "flink", "kubernetes", "k8s",
    "docker", "redis", "concurrent", "async", "parallelism",
    "load balancing", "sharding", "microservices", "grpc",
)
EXTERNAL = (
    "paper", "publication", "patent", "conference", "talk",
    "open source", "arxiv", "neurips", "icml", "acl", "emnlp",
)
PYTHON_IN_CAREER = ("python", "pyspark", "pytest")

COVERED_PRODUCTION = ("production", "deployed", "users", "scale", "million")
COVERED_EVAL = ("ndcg", "mrr", "a/b test", "map", "precision", "recall")
RELIABLE_PRODUCTION = ("production", "deployed", "scale")
RELIABLE_EVAL = ("ndcg", "mrr", "a/b", "evaluation")
SKILL_EVAL = ("ndcg", "mrr")

DATA_INFRA = (
    "spark", "kafka", "airflow", "dbt", "snowflake",
    "hadoop", "pipeline", "etl", "data warehouse", "flink",
)
VISION_AUDIO = (
    "computer vision", "image classification", "object detection",
    "cnn", "yolo", "tts", "speech", "audio", "gans", "resnet",
)
AI_CORE = (
    "nlp", "llm", "fine-tun", "gan", "cnn", "transformer",
    "deep learning", "neural", "computer vision", "speech",
    "prompt engineering", "tts", "mlops", "pytorch", "tensorflow",
)
VISION_TITLES = (
    "computer vision", "cv engineer", "vision engineer",
    "speech engineer", "robotics engineer", "image processing",
)
UNRELATED_TITLES = (
    "hr manager", "hr specialist", "accountant", "graphic designer",
    "content writer", "sales executive", "business analyst",
    "project manager", "operations manager", "marketing manager",
    "civil engineer", "mechanical engineer", "customer support",
    "customer success", "recruiter", "talent acquisition",
    "office manager", "executive assistant",
)
NON_TECH_TITLES = (
    "marketing manager", "accountant", "civil engineer",
    "mechanical engineer", "hr manager", "operations manager",
    "customer support", "project manager", "content writer",
    "graphic designer", "sales executive", "business analyst",
)
RELEVANT_TITLES = (
    "search", "ranking", "retrieval", "recommendation", "relevance",
    "ml engineer", "machine learning engineer", "applied scientist",
    "nlp engineer", "ai engineer", "data scientist",
)

# Outcome language
OUTCOME_WORDS = ("improved", "reduced", "increased")
OUTCOME_VERBS = ("improved", "reduced", "increased", "decreased", "boosted", "grew", "lifted", "cut")
OUTCOME_NOUNS = ("improvement", "increase", "reduction", "lift", "gain", "drop")
OUTCOME_METRICS = (
    "ctr", "click-through", "ndcg", "mrr", "map", "relevance", "engagement", "revenue",
    "retention", "conversion", "latency", "recall", "precision", "search", "ranking",
    "retrieval", "recommendation",
)
OUTCOME_FILLERS = (
    "reported", "saw", "achieved", "recorded", "measured",
    "observed", "delivered", "drove", "the", "a", "an",
)
UNNAMED_METRIC = "a key metric"

# Explanation texts: (needle, sentence part), strongest first
EVIDENCE_PHRASES = (
    ("learning-to-rank", "evolved scoring into a learning-to-rank model"),
    ("learning to rank", "evolved scoring into a learning-to-rank model"),
    ("ltr model", "built and shipped an LTR model"),
    ("ranking layer", "owned the ranking layer end-to-end"),
    ("relevance labeling", "designed the relevance-labeling pipeline feeding the ranker"),
    ("relevance layer", "owned the relevance layer in production"),
    ("ranking system", "built a ranking system in production"),
    ("ranking model", "shipped a ranking model in production"),
    ("search relevance", "owned search relevance for the product"),
    ("search quality", "owned search quality for the product"),
    ("ranker", "shipped a ranker in production"),
)
COMPARATIVE_MARKERS = (
    "lighter weight than", "less sophisticated than", "simpler than",
    "not as", "nowhere near", "far from a full", "a simplified version of",
    "more basic than", "smaller scale than",
)
COMPARATIVE_WINDOW = 60
SUFFIX_EVAL = "backed by formal eval metrics"
SUFFIX_SCALE = "at meaningful production scale"
SCALE_WORDS = ("million", "billion", "qps", "queries per")
# (needles, text, text when ownership is disclaimed), strongest first
EVIDENCE_TOPICS = (
    (("hybrid retrieval", "dense retrieval", "bm25", "semantic search"),
     "shipped hybrid/dense retrieval in production",
     "has hybrid/dense retrieval exposure, though deployment was owned by a different team"),
    (("recommendation system", "recommender", "collaborative filtering", "re-ranking",
      "matrix factorization", "discovery feed", "ranking models for"),
     "built a production recommendation/re-ranking system",
     "built the modeling side of a recommendation/re-ranking system, "
     "though production deployment was owned by a different team"),
    (("ndcg", "mrr", "a/b test", "ab test", "offline-online correlation",
      "offline to online correlation", "click-through", "relevance judgments", "human judgments"),
     "set up offline/online ranking evaluation rigor (eval framework, A/B correlation)",
     "set up offline/online ranking evaluation rigor (eval framework, A/B correlation)"),
    (("embeddings", "vector search", "vector database"),
     "has embeddings/vector-search production experience",
     "has embeddings/vector-search modeling exposure, "
     "though production deployment was owned by a different team"),
    (("matching system", "candidate matching", "job matching", "talent matching"),
     "built a matching system directly analogous to this role",
     "built a matching system directly analogous to this role"),
)
EVIDENCE_CONFIRMED = "has confirmed, title-consistent IR/ranking evidence in their current or past role"
EVIDENCE_MISMATCH_VISION = (
    "primary background is CV/vision-specific; IR/ranking language in profile doesn't match "
    "the role titles -- treat with caution per JD's CV-background warning"
)
EVIDENCE_MISMATCH = (
    "IR/ranking keywords appear in career history but under a job title that doesn't match "
    "-- evidence is inconsistent, verify directly with candidate"
)
EVIDENCE_VISION = (
    "primary background is CV/vision-specific with no NLP/IR exposure "
    "-- per JD, likely needs to re-learn fundamentals"
)
EVIDENCE_FOUNDING = "comes from a product+startup background (founding-team fit)"
EVIDENCE_DEPLOY = "has hands-on production ML deployment experience"
EVIDENCE_DEPLOY_DISCLAIMED = (
    "has ML modeling exposure, though production ownership in their history "
    "was generally handled by other teams"
)
EVIDENCE_DATA = "has strong data-infrastructure experience, but it's adjacent to IR/ranking, not core to it"
EVIDENCE_NONE = "has limited direct evidence of ranking/retrieval/search ownership in their career history"
ML_SIGNAL = ("ml", "model", "machine learning", "neural", "data pipeline", "etl", "feature", "prediction")
DATA_SIGNAL = ("data pipeline", "etl", "spark", "airflow", "kafka")

FILLER_NONE = "no direct IR/ranking/retrieval evidence found in career history"
FILLER_LOW = "insufficient IR/ranking ownership for this role"
FILLER_ADJACENT = "adjacent experience without core ranking/retrieval ownership"
FILLER_HEAD = "Below cutoff - included as mandatory filler to reach 100 candidates"
FILLER_TAIL = "Not a true match for this ranking/retrieval JD."
CONCERN_CRI = "thinner IR depth than ideal"
CONCERN_SKILLS = "skill assessment scores below claimed proficiency"
CONCERN_NOTICE = "-day notice period"
CONCERN_RELOCATION = "not willing to relocate"

# Routes, flags and tracks
ROUTE_PASS = "pass"
ROUTE_REJECT = "hard_reject"
ROUTE_ALTERNATE = "alternate_pipeline"
FLAG_VISA = "Requires Visa Review"
FLAG_PASSIVE = "Passive/Unavailable — Low Pipeline Priority"
FLAG_RESCUED = "Rescued: Foundational Recommender/Search Evidence"
FLAG_CHASER = "Culture Risk: Title-Chaser"
FLAG_SERVICE = "Conditional Consulting Tax Applied"
FLAG_WRAPPER = "LLM Wrapper Penalty"
FLAG_INFLATION = "Skill Inflation Penalty"
FLAG_RESEARCH = "Research-Only Penalty"
FLAG_TENURE = "Tenure Stability Penalty"
TRACK_WRAPPER = "Junior AI / Prompt Engineering"
TRACK_RESEARCH = "Research Collaborator / Advisor Track"
TRACK_SERVICE = "Solutions Architecture / Implementation"
TRACK_VISION = "Computer Vision / Multimodal ML"
TRACK_DATA = "Data Engineering / MLOps"
TRACK_GENERAL = "General Engineering Pipeline"
TRACK_NONE = "None"

# --------------------------------------------------------------------------
# Term lists as replaceable data
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class TermList:
    """Terms split by how they are looked for.

    ``fragments`` may occur anywhere in the text, ``words`` only as whole
    words, ``bounded`` are whole-word terms that contain other characters than
    letters, digits and underscore and so need a literal pattern.
    """

    fragments: tuple[str, ...] = ()
    words: tuple[str, ...] = ()
    bounded: tuple[str, ...] = ()

    def __len__(self) -> int:
        return len(self.fragments) + len(self.words) + len(self.bounded)

    @property
    def terms(self) -> tuple[str, ...]:
        return self.fragments + self.words + self.bounded


def _plain(term: str) -> bool:
    return re.fullmatch(r"\w+", term) is not None


def whole_words(terms) -> TermList:
    terms = tuple(dict.fromkeys(terms))
    return TermList(
        words=tuple(t for t in terms if _plain(t)),
        bounded=tuple(t for t in terms if not _plain(t)),
    )


def fragments(terms) -> TermList:
    return TermList(fragments=tuple(dict.fromkeys(terms)))


def phrases_or_words(terms) -> TermList:
    """Phrases (a blank or hyphen inside, or a leading ``<``) match anywhere,
    single words only whole."""
    terms = tuple(dict.fromkeys(terms))
    loose = tuple(t for t in terms if " " in t or "-" in t or t.startswith("<"))
    rest = whole_words(t for t in terms if t not in loose)
    return TermList(loose, rest.words, rest.bounded)


def fragments_but(words, terms) -> TermList:
    """Fragments, except for the few named terms that must be whole words."""
    rest = whole_words(t for t in terms if t in words)
    return TermList(tuple(t for t in terms if t not in words), rest.words, rest.bounded)


def _default(kind, *lists):
    terms = tuple(dict.fromkeys(t for one in lists for t in one))
    return field(default_factory=lambda: kind(terms))


@dataclass(frozen=True)
class Vocabulary:
    hubs: TermList = _default(fragments, HUBS)
    service_firms: TermList = _default(fragments, SERVICE_FIRMS)
    ir: TermList = _default(phrases_or_words, IR_BASE, RECOMMENDER, LEARNING_TO_RANK)
    recommender: TermList = _default(fragments, RECOMMENDER)
    learning_to_rank: TermList = _default(fragments, LEARNING_TO_RANK)
    builder_verbs: TermList = _default(whole_words, BUILDER_VERBS)
    leader_verbs: TermList = _default(whole_words, LEADER_VERBS)
    passive_verbs: TermList = _default(whole_words, PASSIVE_VERBS)
    ownership_words: TermList = _default(whole_words, OWNERSHIP_WORDS)
    ownership_fragments: TermList = _default(fragments, OWNERSHIP_VERBS)
    ownership_verbs: TermList = _default(phrases_or_words, OWNERSHIP_VERBS)
    genai: TermList = _default(fragments, GENAI)
    business_metrics: TermList = _default(phrases_or_words, BUSINESS_METRICS)
    embedding_ops: TermList = _default(phrases_or_words, EMBEDDING_OPS)
    disclaimers: TermList = _default(fragments, DISCLAIMERS)
    ml_disclaimers: TermList = _default(fragments, DISCLAIMERS, ML_DISCLAIMERS)
    vector_or_eval: TermList = _default(fragments, VECTOR_OR_EVAL)
    coding_titles: TermList = _default(fragments, CODING_TITLES)
    lead_titles: TermList = _default(fragments, LEAD_TITLES)
    ml_role: TermList = field(default_factory=lambda: TermList(fragments=ML_ROLE, words=("ml",)))
    research: TermList = _default(fragments, RESEARCH)
    research_production: TermList = _default(fragments, RESEARCH_PRODUCTION)
    rescue: TermList = _default(fragments, RECOMMENDER, RESCUE_TERMS)
    strong: TermList = _default(fragments, STRONG_TERMS)
    medium: TermList = _default(fragments, MEDIUM_TERMS)
    deploy: TermList = _default(fragments, DEPLOY)
    deploy_or_shipped: TermList = _default(fragments, DEPLOY_OR_SHIPPED)
    relevance_eval: TermList = _default(fragments, RELEVANCE_EVAL)
    formal_eval: TermList = _default(fragments, FORMAL_EVAL)
    production: TermList = _default(phrases_or_words, PRODUCTION_TERMS)
    pre_llm: TermList = _default(phrases_or_words, PRE_LLM)
    skipped_titles: TermList = _default(fragments, SKIPPED_TITLES)
    ml_context: TermList = field(default_factory=lambda: fragments_but(("ml",), ML_CONTEXT))
    build_words: TermList = _default(fragments, BUILD_WORDS)
    early_ml: TermList = field(default_factory=lambda: fragments_but(("ml",), EARLY_ML))
    evaluation: TermList = _default(phrases_or_words, EVAL_TERMS)
    platform: TermList = _default(phrases_or_words, PLATFORM_TERMS)
    architecture: TermList = _default(phrases_or_words, ARCHITECTURE)
    architecture_owned: TermList = _default(fragments, ARCHITECTURE_OWNED)
    architecture_live: TermList = _default(fragments, ARCHITECTURE_LIVE)
    product_industries: TermList = _default(fragments, PRODUCT_INDUSTRIES)
    scale: TermList = _default(fragments, SCALE_TERMS)
    vector_stores: TermList = _default(phrases_or_words, VECTOR_STORES)
    founding: TermList = _default(fragments, FOUNDING)
    python_tools: TermList = _default(fragments, PYTHON_TOOLS)
    python_depth: TermList = _default(fragments, PYTHON_DEPTH)
    distributed: TermList = _default(fragments, DISTRIBUTED)
    external: TermList = _default(fragments, EXTERNAL)
    python_in_career: TermList = _default(fragments, PYTHON_IN_CAREER)
    covered_production: TermList = _default(fragments, COVERED_PRODUCTION)
    covered_eval: TermList = _default(phrases_or_words, COVERED_EVAL)
    reliable_production: TermList = _default(fragments, RELIABLE_PRODUCTION)
    reliable_eval: TermList = _default(fragments, RELIABLE_EVAL)
    skill_eval: TermList = _default(fragments, SKILL_EVAL)
    data_infra: TermList = _default(fragments, DATA_INFRA)
    vision_audio: TermList = _default(fragments, VISION_AUDIO)
    ai_core: TermList = _default(fragments, AI_CORE)
    vision_titles: TermList = _default(fragments, VISION_TITLES)
    contradicting_titles: TermList = _default(fragments, VISION_TITLES, UNRELATED_TITLES)
    non_tech_titles: TermList = _default(fragments, NON_TECH_TITLES)
    relevant_titles: TermList = _default(fragments, RELEVANT_TITLES)
    comparative: TermList = _default(fragments, COMPARATIVE_MARKERS)
    scale_words: TermList = _default(fragments, SCALE_WORDS)
    ml_signal: TermList = field(default_factory=lambda: fragments_but(("ml",), ML_SIGNAL))
    data_signal: TermList = _default(fragments, DATA_SIGNAL)

    def with_terms_table(self, terms, max_rows: int = 5000) -> "Vocabulary":
        """Replace lists by the rows of a ``(taxonomy, term, mode)`` table.

        ``mode`` is ``substring`` or ``word``.  Term lists become literals of
        the plan, so the table must be small; its size is checked.
        """
        rows = terms.select("taxonomy", "term", "mode").limit(max_rows + 1).collect()
        if len(rows) > max_rows:
            raise ValueError(f"a vocabulary holds at most {max_rows} terms")
        known = {f.name for f in fields(self)}
        grouped: dict[str, dict[str, list[str]]] = {}
        for row in rows:
            if row.taxonomy not in known:
                raise ValueError(f"unknown taxonomy {row.taxonomy!r}")
            if row.mode not in ("substring", "word"):
                raise ValueError(f"mode must be 'substring' or 'word', not {row.mode!r}")
            grouped.setdefault(row.taxonomy, {"substring": [], "word": []})[row.mode].append(
                row.term.lower()
            )
        lists = {}
        for name, by_mode in grouped.items():
            words = whole_words(sorted(by_mode["word"]))
            lists[name] = TermList(tuple(sorted(set(by_mode["substring"]))), words.words, words.bounded)
        return replace(self, **lists)

    @property
    def all_words(self) -> frozenset[str]:
        """Every whole-word term of every list."""
        return frozenset(w for f in fields(self) for w in getattr(self, f.name).words)

    @property
    def all_fragments(self) -> frozenset[str]:
        """Every fragment of every list."""
        return frozenset(t for f in fields(self) for t in getattr(self, f.name).fragments)

    def as_rows(self) -> list[tuple[str, str, str]]:
        """The lists as ``(taxonomy, term, mode)`` rows, ready to edit as a table."""
        out = []
        for f in fields(self):
            one: TermList = getattr(self, f.name)
            out += [(f.name, t, "substring") for t in one.fragments]
            out += [(f.name, t, "word") for t in one.words + one.bounded]
        return out

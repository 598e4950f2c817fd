"""Profiles derived from the order tables.

Each customer becomes one profile: all orders are the jobs, all line items
the skills, events the activity signals, and a document the summary.  A document
without a customer is a profile of its own that has no jobs and skills.  The
invented sentences below bring in the vocabulary that the tables lack; which
job gets which sentence depends on the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from profilerank.functions.text import bind

DATE_SHIFT = 9131
ACTIVITY_SHIFT = 865

TITLES = (
    "Senior Machine Learning Engineer", "Data Engineer", "HR Manager", "Computer Vision Engineer",
    "Junior Engineer", "Staff Software Engineer", "Principal Engineer", "Search Engineer",
    "Engineering Manager", "Data Scientist", "Business Analyst", "Director of Engineering",
    "Recommendation Systems Engineer", "Contractor", "", "Backend Engineer", "Applied Scientist",
)
WORK = (  # invented sentences
    "Designed and shipped the ranking layer for product search; Python services in production, NDCG and MRR tracked.",
    "Built a learning-to-rank model with LightGBM ranker in Python; improved revenue-per-search by 12% in an A/B test.",
    "Owned the recommendation system: collaborative filtering and matrix factorization, deployed to 10 million users, lifted retention by 6.5%.",
    "Worked with a team that built a ranking system in Python; deployment was handled by the platform team.",
    "Python scorer, lighter weight than ranking systems at larger firms, for candidate matching.",
    "ETL pipeline with Spark, Kafka and Airflow for the data warehouse in Python; reduced cost 3x over a year.",
    "Research at a university laboratory on neural prediction.",
    "LangChain and LlamaIndex chatbot over the OpenAI API; generative RAG application with promptflow.",
    "",
    "Failed to map the planning roadmap; handled governance and maintenance.",
    "Hybrid retrieval with BM25 and dense retrieval on FAISS and HNSW, p99 query latency cut by 40%.",
    "Trained XGBoost and random forest models on retail outbound data, python scikit-learn.",
    "Implemented embeddings and vector search in Python with pgvector, index refresh and drift monitoring in production.",
    "Search relevance owner: click-through rate improved from 0.12 to 0.17, offline eval with human judgments.",
    "Led a SaaS platform from scratch, MVP to Series A, fast-paced startup with ambiguity.",
    "Object detection with YOLO and CNN, speech and audio pipelines, computer vision in production.",
    "PySpark jobs on a distributed Kubernetes cluster with Docker, Redis and gRPC microservices.",
    "Reported search-relevance improvement of 35% and saw a 6% lift in retention after a ranker rewrite in Python.",
    "Candidate generation and two-tower matching system in python, evaluation methodology with recall@ 5 and precision@10.",
    "Accounting reports and office work for clients.",
    "Machine learning model serving: canary, shadow mode, throughput and inference latency in production; built with pytest.",
    "Personalization and feed ranking; recommender increased CTR by 9% and conversion by 9%.",
    "Supported and assisted the analytics team, helped with dashboards, worked on data pipeline feature work.",
    "I wouldn't call myself an ML specialist; 70% data infrastructure, some ML models.",
    "Deployed fraud prediction in production; 4 x faster than before and 12.5 x cheaper per query.",
    "Owned the search and ranking quality; A/B tests showed +4.2pp engagement.",
    "Semantic search over a vector database, recall optimization with an inverted index and sharding.",
    "Researched and investigated papers, published at a conference; open source talk.",
    "Secondary role: my own modeling work was secondary for the recommendation engine.",
)
EXTRA = (
    "Python, pytest and FastAPI backend with system design reviews.",
    "Architected, designed, built, shipped, launched, deployed, led, drove, owned, scaled and mentored on a data platform.",
    "",
    "Collaborated and contributed; participated in planning.",
    "Marketplace matching with entity matching, owned ranking strategy.",
    "TB scale, billion rows, 100ms latency at scale, high throughput QPS.",
    "Developed, implemented, created, released and delivered services; coordinated and managed delivery.",
    "Reported an increase of 20% and a reduction in 15% errors.",
    "Early BERT and word2vec work, SVM and logistic regression.",
    "Relevance labeling pipeline, query understanding and query expansion.",
    "Sentence-transformers with a bi-encoder and a cross-encoder, ColBERT and ance.",
    "Boosted the a an the click through rate by 3.25 % within a month.",
    "Simpler than a full search engine, nowhere near ranking model work.",
    "Patent and arXiv paper; NeurIPS talk.",
    "Improved documentation and onboarding.",
    "Milvus, Pinecone, Qdrant and Weaviate; re-indexing and embedding monitoring.",
    "Offline metrics correlated with online engagement, annotation and relevance judgments.",
    "Infrastructure, system and pipeline work with revenue and active users metrics.",
    "Django, Flask, asyncio, profiling and Celery.",
    "It wasn't my role to deploy; someone else deployed it.",
    "The ltr model grew revenue 8 % quarter over quarter.",
    "Prototype for the founding team, zero to one, greenfield.",
    "Discovery feed and content recommendations, re-ranking.",
)
COMPANIES = (
    "Infosys Ltd", "Acme Search", "TCS", "Wipro Digital", "Brightloop", "Persistent Systems",
    "Nimbus AI", "Oakmart", "Accenture",
)
INDUSTRIES = ("Software", "Retail", "FinTech", "Agriculture", "Media", "Government", "EdTech")
SIZES = ("1-10", "11-50", "51-200", "201-500", "10001+")
CITIES = ("Pune, Maharashtra", "Noida", "Bengaluru", "Chennai", "Kolkata", "New Delhi", "Jaipur", "Greater Noida West")
SKILLS = (
    "Python", "NDCG", "FAISS", "Learning-to-Rank", "Ranking", "Information Retrieval", "PyTorch", "Kafka",
    "NLP", "Speech Recognition", "Elegant Design", "Embeddings", "Spark", "MRR", "Planning", "Excel",
    "Semantic Search", "precision@k", "Vector DB", "Transformers",
)
LEVELS = ("beginner", "intermediate", "advanced", "expert", "guru")
HEADLINES = (
    "Engineer in Python", "Search and recommendation", "Analyst", "Vision specialist at scale", "",
)
CERTIFICATES = ((), ("AWS Solutions",), ("TensorFlow Certificate", "Kubernetes Admin"), ("MLOps",))
NOTICE = (15, 30, 60, 90, 120)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in values]), (index % len(values) + 1).cast("int"))


def _date_text(date: Column) -> Column:
    return date.cast("string")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of each customer as jobs, newest first; a job ends when the next one starts."""
    items = (table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct(
        F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderkey").alias("key"))), asc=False).alias("orders")))
    began = lambda x: F.date_add(x["day"], DATE_SHIFT)

    def job(x, i):
        key = x["key"]
        # the one before, which is newer; elements are counted from 1, and 0 is none
        ended = F.try_element_at(F.col("orders"), F.greatest(i, F.lit(1)))["day"]
        return F.struct(
            (i + 1).alias("pos"),
            _pick(TITLES, key).alias("title"),
            F.rtrim(F.concat(_pick(WORK, key), F.lit(" "), _pick(EXTRA, key * 7 + F.col("o_custkey")))).alias("description"),
            _pick(COMPANIES, key).alias("company"),
            _pick(INDUSTRIES, key).alias("industry"),
            _pick(SIZES, key + F.col("o_custkey")).alias("company_size"),
            F.when(key % 37 == 0, "15-06-2020").when(key % 41 == 0, "").otherwise(_date_text(began(x))).alias("start_date"),
            F.when(i == 0, F.lit(None)).when(key % 43 == 0, "unknown")
            .otherwise(_date_text(F.date_add(ended, DATE_SHIFT))).alias("end_date"),
            F.when(key % 23 != 0, (key % 40).cast("int")).alias("duration_months"),
            ((i == 0) | ((i == 1) & (key % 17 == 0))).alias("is_current"))

    return items.select("o_custkey", F.transform("orders", job).alias("career_history"))


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items of each customer as skills, with test scores by name."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    owner = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size")
    key = F.col("l_partkey")
    # Only what a skill is made of is shuffled and collected; name, level and test follow from it afterwards.
    item = F.struct(
        (-F.col("l_orderkey")).alias("order"), F.col("l_linenumber").alias("line"), key.alias("part"),
        F.col("l_suppkey").alias("supplier"), F.col("l_quantity").alias("quantity"),
        F.when(key % 3 == 1, F.col("p_name")).alias("name"), F.when(key % 3 != 0, F.col("p_size")).otherwise(0).alias("size"))
    items = (lines.join(owner, "l_orderkey").join(part, "l_partkey")
             .groupBy("o_custkey").agg(F.sort_array(F.collect_list(item)).alias("items")))
    name = lambda x: F.when(x["part"] % 3 == 1, x["name"]).otherwise(_pick(SKILLS, x["part"]))

    def skill(x):
        return F.struct(
            name(x).alias("name"),
            F.when(x["part"] % 7 != 0, _pick(LEVELS, x["part"])).alias("proficiency"),
            x["size"].alias("duration_months"),
            F.when(x["part"] % 3 != 0, x["quantity"].cast("int")).otherwise(0).alias("endorsements"))

    tested = F.sort_array(F.transform(
        F.filter("items", lambda x: x["part"] % 5 != 0),
        lambda x: F.struct(name(x).alias("name"), (x["part"] * 13 % 101).cast("double").alias("score"))))
    # Sorted by name and score, the last entry of a name is its best one.
    best = bind(tested, lambda tests: F.filter(tests, lambda t, i: ~F.coalesce(
        F.try_element_at(tests, i + 2)["name"] == t["name"], F.lit(False))))
    return items.select("o_custkey", F.transform("items", skill).alias("skills"), F.map_from_entries(best).alias("tests"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return (table(spark, sf_dir, "events").select("user_id", "event_type", "ts")
            .groupBy("user_id").agg(
                F.count("*").alias("n_events"),
                F.count_if(kind == "purchase").alias("n_purchase"),
                F.count_if(kind == "signup").alias("n_signup"),
                F.max("ts").alias("last_ts")))


def _id(key: Column) -> Column:
    return F.concat(F.lit("C"), F.lpad(key.cast("string"), 8, "0"))


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, candidate_id) of all profiles, each once."""
    keys = table(spark, sf_dir, "customer").select("c_custkey").union(table(spark, sf_dir, "documents").select("doc_id"))
    return keys.distinct().withColumn("candidate_id", _id(F.col("c_custkey")))


def profiles(spark: SparkSession, sf_dir: str, copies: int = 1, marks: DataFrame | None = None) -> DataFrame:
    """Nested profiles in the input schema; ``copies`` repeats them under new ids.

    ``marks`` has a row for some ``c_custkey`` and further columns, which the profiles get; it joins before jobs and
    skills, so that no wide row is shuffled for it.
    """
    key = F.col("c_custkey")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    summaries = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("c_custkey"), "text")
    base = (table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
            .join(summaries, "c_custkey", "full")
            .join(nation, "c_nationkey", "left"))
    marked = [c for c in marks.columns if c != "c_custkey"] if marks else []
    base = base.join(marks, "c_custkey", "left") if marked else base
    base = (base
            .join(jobs(spark, sf_dir).withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
            .join(skills(spark, sf_dir).withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
            .join(activity(spark, sf_dir).withColumnRenamed("user_id", "c_custkey"), "c_custkey", "left"))
    country = (F.when(F.col("c_nationkey") % 5 == 0, F.col("n_name"))
               .when(F.col("c_nationkey") % 5 == 1, " IN ").otherwise("India"))
    last_active = (
        F.when(key % 31 == 0, "15-06-2026").when(key % 37 == 0, "")
        .when(F.col("last_ts").isNotNull(),
              _date_text(F.date_add(F.col("last_ts").cast("date"), ACTIVITY_SHIFT)))
        .otherwise(_date_text(F.date_sub(F.lit("2026-06-15").cast("date"), (key % 400).cast("int")))))
    share = lambda n: F.col(n) / F.col("n_events")
    # The newest job comes first in the array and decides the title.
    newest_title = F.try_element_at(F.col("career_history"), F.lit(1))["title"]
    nested = base.select(
        _id(key).alias("candidate_id"),
        F.struct(
            F.col("text").alias("summary"),
            F.concat_ws(" ", _pick(HEADLINES, key), F.lower(F.coalesce("c_mktsegment", F.lit("none")))).alias("headline"),
            F.when(key % 29 != 0, newest_title).alias("current_title"),
            country.alias("country"), _pick(CITIES, key).alias("location"),
            ((key * 7 % 160) / 10.0).alias("years_of_experience")).alias("profile"),
        F.transform("career_history", lambda j: F.struct(*[j[c].alias(c) for c in (
            "title", "description", "company", "industry", "company_size", "start_date", "end_date",
            "duration_months", "is_current")])).alias("career_history"),
        F.transform("skills", lambda s: F.struct(*[s[c].alias(c) for c in (
            "name", "proficiency", "duration_months", "endorsements")])).alias("skills"),
        F.transform(
            _pick([list(c) or [""] for c in CERTIFICATES], key),
            lambda n: F.struct(n.alias("name"))).alias("certifications"),
        F.struct(
            F.col("tests").alias("skill_assessment_scores"),
            F.when(key % 4 != 0, key % 4 != 1).alias("willing_to_relocate"),
            (key % 3 != 0).alias("open_to_work_flag"),
            last_active.alias("last_active_date"),
            F.when(key % 13 != 0, _date_text(F.date_add(
                F.lit("2024-01-01").cast("date"), (key * 7 % 900).cast("int")))).alias("signup_date"),
            F.when(key % 11 != 0, _pick(NOTICE, key)).alias("notice_period_days"),
            F.when(F.col("n_events").isNotNull(), share("n_purchase"))
            .when(key % 3 != 0, (key % 101) / 100.0).alias("recruiter_response_rate"),
            F.when(F.col("n_events").isNotNull(), share("n_signup"))
            .when(key % 7 != 0, (key * 3 % 101) / 100.0).alias("interview_completion_rate"),
            F.when(key % 9 != 0, (key * 3 % 120 - 20).cast("double")).alias("github_activity_score"),
            (key % 2 == 0).alias("verified_email"),
            F.when(key % 5 != 0, key % 3 == 0).alias("verified_phone"),
            F.struct((key % 40).cast("double").alias("min"),
                     (key * 3 % 45).cast("double").alias("max")).alias("expected_salary_range_inr_lpa"),
        ).alias("signals"),
        *marked)
    if copies > 1:
        nested = (nested.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
                  .withColumn("candidate_id", F.concat_ws("-", "candidate_id", F.col("_copy").cast("string")))
                  .drop("_copy"))
    return nested

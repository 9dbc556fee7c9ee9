"""Lists, limits and texts that decide results and are not tuned.

Everything in this module is data.  Callers may pass their own list or limit to the operator that
uses one; these are the defaults.
"""

from __future__ import annotations

# The technical vocabulary that weighs 70 % in the keyword score.
TECH_TERMS = (
    "python", "java", "javascript", "typescript", "golang", "rust", "scala", "kotlin", "swift",
    "ruby", "php", "csharp", "cplusplus",
    "react", "angular", "vue", "nextjs", "html", "css", "webpack",
    "nodejs", "django", "fastapi", "flask", "spring", "rails",
    "aws", "gcp", "azure", "kubernetes", "docker", "terraform", "helm", "ansible", "jenkins",
    "github", "gitlab", "circleci",
    "spark", "kafka", "airflow", "pytorch", "tensorflow", "sklearn", "pandas", "numpy", "dbt",
    "snowflake", "databricks",
    "postgresql", "mysql", "mongodb", "redis", "elasticsearch", "cassandra", "dynamodb", "sqlite",
    "graphql", "grpc", "rest", "linux", "git",
)

# Share of technical and of other words in the keyword score.
TECH_SHARE = 0.7
OTHER_SHARE = 0.3

# The English list that ships with Spark's StopWordsRemover.
ENGLISH_STOP_WORDS = tuple(
    """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she
her hers herself it its itself they them their theirs themselves what which who whom this that
these those am is are was were be been being have has had having do does did doing a an the and
but if or because as until while of at by for with about against between into through during
before after above below to from up down in out on off over under again further then once here
there when where why how all any both each few more most other some such no nor not only own
same so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll
i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't
shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's
what's when's where's who's why's would
""".split()
)

# Companies that are job boards or staffing agencies, and blocked title words.  The
# trailing space in "VP of " is part of the keyword.
COMPANY_BLOCKLIST = (
    "Jobot", "Crossover", "hackajob", "Dice", "Jobs via Dice", "CyberCoders", "Staffmark",
    "TEKsystems", "Apex Systems", "RemoteHunter", "DataAnnotation", "Mercor", "Alignerr",
    "Crossing Hurdles", "AgileGrid Solutions", "Jobright.ai", "Rex.zone", "Jobs Ai", "Jobgether",
    "Quick Hire Staffing", "Sundayy",
)
TITLE_BLOCKLIST = ("Staff", "Principal", "Director", "VP of ", "Vice President")
CLEARANCE_KEYWORDS = ("TS/SCI", "security clearance", "polygraph")

# Names by which a predicate of the ingest chain can be switched off, in the order
# in which the funnel counts them.
FILTER_NAMES = (
    "seen", "company_blocklist", "title_blocklist", "title_allowlist", "location",
    "location_exclusion", "remote", "description_blocklist", "description_allowlist",
)

# Columns of a posting that are kept on output.
POSTING_COLUMNS = (
    "id", "site", "job_url", "job_url_direct", "title", "company", "location", "job_type",
    "date_posted", "salary_source", "interval", "min_amount", "max_amount", "currency",
    "is_remote", "job_level", "job_function", "listing_type", "emails", "description",
    "company_industry", "company_url", "company_url_direct", "company_addresses",
    "company_num_employees", "company_revenue", "company_description", "logo_photo_url",
    "banner_photo_url", "ceo_name", "ceo_photo_url",
)

# Columns of the scored report.
REPORT_COLUMNS = (
    "id", "site", "job_link", "company", "location", "job_type", "is_remote", "job_level",
    "job_function", "keyword_match_score", "tfidf_cosine_score", "semantic_score",
    "cross_encoder_score", "llm_fit_score", "llm_fit_rationale", "final_score", "description",
)

# The prompt handed to an external answering service.
ANSWER_PROMPT = """\
Rate how well this candidate fits the job. Respond with exactly two lines:
SCORE: <integer 0-10>
REASON: <one sentence explaining the main fit or gap>

JOB DESCRIPTION:
{job}

CANDIDATE RESUME:
{resume}"""

# Encoder name -> (public model id, whether texts get a leading instruction).
ENCODER_MODELS = {
    "bge-large": ("BAAI/bge-large-en-v1.5", True),
    "bge-base": ("BAAI/bge-base-en-v1.5", True),
    "bge-small": ("BAAI/bge-small-en-v1.5", True),
    "bge-m3": ("BAAI/bge-m3", True),
    "minilm": ("sentence-transformers/all-MiniLM-L6-v2", False),
    "mpnet": ("sentence-transformers/all-mpnet-base-v2", False),
    "mxbai": ("mixedbread-ai/mxbai-embed-large-v1", False),
}
POSTING_PREFIX = "Represent this job posting: "
PROFILE_PREFIX = "Represent this resume: "

# Pair scorer name -> public model id.
PAIR_MODELS = {
    "bge-reranker-v2-m3": "BAAI/bge-reranker-v2-m3",
    "bge-reranker-large": "BAAI/bge-reranker-large",
    "ms-marco-l12": "cross-encoder/ms-marco-MiniLM-L-12-v2",
    "ms-marco-l6": "cross-encoder/ms-marco-MiniLM-L-6-v2",
}

# Lower bound, colour and badge of a score band, best first.
SCORE_BANDS = (
    (80, "#22c55e", "badge-green"),
    (60, "#f59e0b", "badge-amber"),
    (40, "#f97316", "badge-orange"),
    (None, "#ef4444", "badge-red"),
)

# Inclusive ranges of the report's band filter, by the option's name.
BAND_FILTERS = {"80": (80, 100), "60": (60, 79), "40": (40, 59), "0": (0, 39)}

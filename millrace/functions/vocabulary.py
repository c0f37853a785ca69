"""Fixed values of the retrieval rules: token sets, phrases, patterns and defaults. Results depend on every entry."""

# Words that tokenize() drops.
STOPWORDS = "a an and are as at be been being by can could did do does for from had has have how i if in is it its may me might my of on or our should that the this to was we were what when where which who will with would you your".split()

# Token sets of the query planner and of the boosts.
UNDERGRADUATE = "bachelor bachelors freshman freshmen junior senior sophomore undergrad undergraduate".split()
GRADUATE = "dissertation doctoral doctorate grad graduate master masters ms phd thesis".split()
SCHEDULE = "availability available fall next offer offered offering opportunity rotation schedule semester spring summer".split()
REQUIREMENT = "between compare comparing comparison difference differences distinguish must need needs required requirement requirements versus vs".split()
TOPIC = "about address addresses between compare comparing cover covering covers difference differences distinguish focus focuses include includes involve involves related teach teaches topics versus vs".split()
POLICY = "deadline deadlines hold holds policies policy procedure procedures process rule rules viewing vww wider world".split()
GENERAL_EDUCATION = "education gen gened general viewing vww wider world".split()
FACULTY = "adviser advisor contact doctor dr email faculty instructor office professor research teaches who".split()
ENROLLMENT = "admission admissions admit admitted application applications apply enroll enrollment register registration".split()
COMPARISON = "between versus vs".split()
AVAILABILITY = "availability available enroll enrollment offered offering open register registration seats sections".split()
DEGREE_TRIGGERS = "bachelor degree major master phd program".split()
MINOR_TYPES = "minor_requirement minor_index degree_overview general advising course_description".split()
REQUIREMENT_TYPES = "degree_core_requirement degree_requirement concentration_requirement".split()

# Phrases.
SEMESTER_PHRASES = ["current semester", "fall semester", "next fall", "next semester", "next spring", "next summer", "spring semester", "summer session", "this fall", "this semester", "this spring", "this summer"]
GENERAL_EDUCATION_PHRASES = ["gen ed", "general education"]
WIDER_WORLD_PHRASES = ["viewing a wider world", "vww", "wider world"]
CREDIT_PHRASES = ["credit hours", "how many credit", "how many credits", "worth"]

# Words that a title search drops.
TITLE_NOISE = "a about an called can contribute count counts course courses credit credits do does ed education for fulfill fulfills gen general get hours how i into is many my named requirement requirements satisfies satisfy take that the this to toward viewing vww which wider will world worth".split()

# Acronyms, in the order in which expansions are appended.
ACRONYMS = {
    "AI": "Artificial Intelligence",
    "ML": "Machine Learning",
    "HCI": "Human Computer Interaction",
    "NLP": "Natural Language Processing",
    "OS": "Operating Systems",
    "SE": "Software Engineering",
    "DS": "Data Science",
    "DB": "Database",
    "MAP": "Masters Accelerated Program",
    "CAASS": "Center for Academic Advising and Student Support",
    "VWW": "Viewing a Wider World",
}

# Department keywords, in the order in which they are tried.
DEPARTMENTS = {
    "math": "MATH",
    "mathematics": "MATH",
    "physics": "PHYS",
    "chemistry": "CHEM",
    "biology": "BIOL",
    "history": "HIST",
    "english": "ENGL",
    "philosophy": "PHIL",
    "sociology": "SOCI",
    "psychology": "PSYC",
    "economics": "ECON",
    "political": "POLS",
    "anthropology": "ANTH",
    "geography": "GEOG",
    "astronomy": "ASTR",
    "communication": "COMM",
    "theatre": "THEA",
    "theater": "THEA",
    "music": "MUSC",
    "art": "ARTH",
    "honors": "HNRS",
    "computer": "CSCI",
}

# Words that fact coverage leaves out.
FACT_STOPWORDS = "a an and are as at be been being by for from in is it no not of on or that the this to was were with".split()

# Course code patterns of pages and evaluation, of the catalog, and of questions.
PAGE_CODE = r"\b([A-Z][A-Z\s]{0,5}\s+\d{3,4}[A-Z]?)\b"
CATALOG_CODE = r"\b([A-Z]{1,4}(?:\s[A-Z]{1,4})?\s+\d{3,4}[A-Z]?)\b"
QUESTION_CODE = r"\b([A-Z]{1,5}\s+\d{3,4}[A-Z]?)\b"
COURSE_ENTRY = r"^([A-Z]{1,4}(?:\s[A-Z]{1,4})?\s+\d{3,4}[A-Z]?)\.\s+(.+)$"
TOC_LINE = r"^(.+?)\s*\.{2,}\s*(\d+)\s*$"
QUESTION_MARKER = r"(?<!\w)Q\d+(?=[\s.])"

# Patterns of filler in an answer, of an opening that isn't an answer, and of a link.
FILLER = r"(?i)\b(great question|certainly[!,]?|of course[!,]?|i'?d be happy to help|as an ai|i'?m here to help|absolutely[!,]?|sure[!,]?)\b"
OPENER = r"(?i)^\s*(great|certainly|of course|i'?d be happy|as an ai|i'?m here|absolutely|sure)[!,\s]"
LINK = r"""https?://[^\s)\]>,"']+"""

# Degrees by a phrase of the title (type, level), and families by a phrase of the department's name.
DEGREES = {"bachelor of arts": ("ba", "undergraduate"), "bachelor of science": ("bs", "undergraduate"), "master of": ("ms", "ms"), "doctor of": ("phd", "phd")}
FAMILIES = ["computer science", "data analytics", "bioinformatics", "electrical engineering"]

# The columns of the retrieval export and of the two result tables.
EXPORT = "timestamp_utc department_id question answer sources prompt_context chunk_count chunk_rank chunk_id chunk_type content_source heading source course_code referenced_courses catalog_year catalog_page catalog_page_end level degree_type degree_full_title concentration policy_topic lab score hybrid_score metadata_boost final_score text".split()
ANSWER_FIELDS = "question_id category question passed system_answer".split()
SCORE_FIELDS = "question_id category passed retrieval_score judge_total recall_at_k precision_at_1 source_type_correct faithfulness completeness hallucination response_quality latency_ms judge_reasoning".split()
RETRIEVED = "chunk_id rank hybrid_score metadata_boost final_score chunk_type content_source heading source".split()

# Defaults.
TOP_K, ALPHA, MIN_CHARS, MAX_CHARS, TOKEN_LIMIT = 5, 0.75, 150, 2000, 8192

# The columns of the sheet that people review, and the fields of a chunk in the older store.
REVIEW = "question_id category judge_pass judge_total human_pass human_notes question system_answer judge_reasoning".split()
LEGACY = "text chunk_type catalog_page catalog_page_end chunk_id dept_name program_family degree_level degree_type concentration degree_full_title course_code course_title credits dept_prefix course_number_level has_prerequisites policy_topic lab_name referenced_courses catalog_year source_scope is_research_related".split()

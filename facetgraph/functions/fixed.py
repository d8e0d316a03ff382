"""They must equal the ones the reported results were made with."""

# Name endings and beginnings of infrastructure classes, current rule set.
CORE_SUFFIXES = [
    "Action", "Form", "Controller", "Validator", "Interceptor", "Client", "Advice", "Session",
    "Servlet", "Test", "Loader", "Parser", "Result", "Results", "Stats", "Totals", "Runner",
    "Main", "Config", "Configuration", "Constants", "Factory", "Manager", "Locator",
    "Generator", "Helper", "Util", "Utils", "Utility",
]
CORE_PREFIXES = [
    "Base", "Secure", "MsSql", "Oracle", "JaxRpc", "Mock", "SQL", "Mongo", "WXS", "Jmeter",
    "Nmon", "Rest", "REST", "Ping", "Help", "Populate",
]

# The older, shorter rule set.
CORE_SUFFIXES_V4 = [
    "Action", "Form", "Controller", "Validator", "Interceptor", "Client", "Advice", "Session",
    "Servlet",
]
CORE_PREFIXES_V4 = ["Base", "Secure", "MsSql", "Oracle", "JaxRpc", "Mock"]

# Relation scores.
INHERITANCE_SCORE = 15
INSTANTIATION_SCORE = 8
ATTRIBUTE_SCORE = 5
METHOD_SIGNATURE_SCORE = 3

# Technical terms removed from summaries.
TECHNICAL_TERMS = [
    "dao", "implementation", "impl", "interface", "class", "java", "database", "db", "sql",
    "map", "hashmap", "string", "int", "integer", "void", "return", "jdbc", "persistence",
    "query",
]

# Stop words of source code.
CODE_STOP_WORDS = [
    "get", "set", "is", "has", "to", "from", "dao", "impl", "service", "factory", "id", "new",
]

# The usual English stop-word list.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself "
    "yourselves he him his himself she she's her hers herself it it's its itself they them "
    "their theirs themselves what which who whom this that that'll these those am is are was "
    "were be been being have has had having do does did doing a an the and but if or because "
    "as until while of at by for with about against between into through during before after "
    "above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own "
    "same so than too very s t can will just don don't should should've now d ll m o re ve y "
    "ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven "
    "haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn "
    "shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()

# Where controllers live.
CONTROLLER_PACKAGES = ["web/spring", "web/struts"]
CONTROLLER_ENDINGS = ["Controller.java", "Action.java"]

# Fallback and framing texts.
SUMMARY_FALLBACK = "%s represents the business concept of %s."
SCENARIO_FALLBACK = "General Utility"
FUNCTIONAL_TEXT_FALLBACK = "%s represents general utility."
FUNCTIONAL_FRAME = "%s participates in: %s"
FUNCTIONAL_FRAME_V4 = "%s is used in: %s"

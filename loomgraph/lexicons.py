"""Fixed word lists, patterns and type vocabularies of the graph model.

These values decide which rows a query returns, so they are stated plainly. The same
constants are rendered into the oracle SQL.
"""

from __future__ import annotations

# ---- Fixed values: type vocabularies, in index order

NODE_TYPES = [
    "DOCUMENT", "PARAGRAPH", "SENTENCE", "TOKEN", "ENTITY", "PREDICATE", "ARGUMENT", "CONCEPT",
    "NOUN_PHRASE", "VERB_PHRASE", "CLAUSE", "MENTION", "TOPIC",
]
EDGE_TYPES = [
    "DEP", "NEXT_TOKEN", "NEXT_SENT", "NEXT_PARA", "COREF", "SRL_ARG", "AMR_EDGE", "RST_RELATION",
    "DISCOURSE", "CONTAINS", "BELONGS_TO", "ENTITY_REL", "SIMILARITY",
]
SECURITY_NODE_TYPES = [
    "CVE_ID", "CWE_ID", "SOFTWARE", "VERSION", "COMPONENT", "CODE_ELEMENT", "ATTACK_VECTOR", "IMPACT",
    "REMEDIATION", "THREAT_ACTOR", "VULN_TYPE", "SEVERITY",
]
SECURITY_EDGE_TYPES = [
    "AFFECTS", "HAS_VERSION", "LOCATED_IN", "CLASSIFIED_AS", "EXPLOITED_BY", "CAUSES", "MITIGATED_BY",
    "USES_FUNCTION", "THREATENS", "HAS_SEVERITY",
]
CROSS_MODAL_NODE_TYPES = ["CODE_PATTERN", "TEXT_ANCHOR", "ALIGNMENT"]
CROSS_MODAL_EDGE_TYPES = ["REFERS_TO", "DESCRIBES", "MAPS_TO", "ABSENCE_OF", "INSTANTIATES"]

# ---- Fixed values: words of the generic front end

AUXILIARY_VERBS = [
    "is", "was", "were", "are", "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "will", "would", "shall", "should", "may", "might", "can", "could",
]
COMMON_VERBS = [
    "said", "took", "gave", "made", "went", "got", "came", "knew", "saw", "found", "told", "asked",
    "used", "called", "tried", "left", "put", "kept", "let", "began", "seemed", "helped", "showed",
    "heard", "played", "moved", "lived", "believed", "brought", "happened", "wrote", "provided",
    "sat", "stood", "lost", "paid", "met", "ran", "set", "learned", "changed", "led", "understood",
    "watched", "followed", "stopped", "created", "spoke", "read", "allowed", "added", "grew",
    "opened", "walked", "won", "taught", "offered", "remembered", "considered", "appeared",
    "bought", "served", "died", "sent", "built", "stayed", "fell", "reached", "killed", "raised",
    "passed", "sold", "decided", "returned", "continued", "reported", "admitted", "prescribed",
    "worsened", "ordered", "revised", "responded", "discharged", "detected", "discovered",
    "treated", "diagnosed", "analyzed",
]
ROLE_OF_DEP = {
    "nsubj": "ARG0", "nsubjpass": "ARG1", "dobj": "ARG1", "iobj": "ARG2", "agent": "ARG0",
    "advmod": "ARGM-ADV", "neg": "ARGM-NEG", "mark": "ARGM-DIS", "npadvmod": "ARGM-TMP",
    "tmod": "ARGM-TMP", "prep": "ARGM-LOC", "oprd": "ARG2", "xcomp": "ARG1", "ccomp": "ARG1",
    "acomp": "ARG2", "attr": "ARG1", "dative": "ARG2",
}
CLAUSE_DEPS = ["advcl", "relcl", "ccomp", "acl"]
VERB_GROUP_DEPS = ["aux", "auxpass", "neg", "prt", "advmod"]

# ---- Fixed values: words of the passes

PRONOUNS = {
    "male": ["he", "him", "his", "himself"],
    "female": ["she", "her", "hers", "herself"],
    "neutral": ["it", "its", "itself"],
    "plural": ["they", "them", "their", "theirs", "themselves"],
    "demonstrative": ["this", "that", "these", "those"],
    "relative": ["who", "whom", "which", "whose"],
}
PERSON_TYPES = ["PERSON", "PER"]
GROUP_TYPES = ["ORG", "NORP", "GPE"]
DISCOURSE_MARKERS = {
    "however": "contrast", "but": "contrast", "although": "concession", "nevertheless": "contrast",
    "yet": "contrast", "whereas": "contrast", "despite": "concession", "on the other hand": "contrast",
    "in contrast": "contrast", "conversely": "contrast", "even though": "concession",
    "nonetheless": "contrast", "notwithstanding": "concession", "still": "contrast",
    "because": "cause", "since": "cause", "therefore": "result", "consequently": "result",
    "thus": "result", "hence": "result", "as a result": "result", "due to": "cause", "so": "result",
    "accordingly": "result", "for this reason": "result", "owing to": "cause",
    "for example": "elaboration", "for instance": "elaboration", "specifically": "elaboration",
    "in particular": "elaboration", "moreover": "elaboration", "furthermore": "elaboration",
    "additionally": "elaboration", "also": "elaboration", "indeed": "elaboration",
    "in fact": "elaboration", "that is": "elaboration", "namely": "elaboration",
    "then": "temporal", "after": "temporal", "before": "temporal", "meanwhile": "temporal",
    "subsequently": "temporal", "finally": "temporal", "first": "temporal", "next": "temporal",
    "later": "temporal", "previously": "temporal", "at the same time": "temporal",
    "simultaneously": "temporal", "if": "condition", "unless": "condition", "provided": "condition",
    "assuming": "condition", "in case": "condition", "otherwise": "condition",
    "in summary": "summary", "in conclusion": "summary", "overall": "summary",
    "to summarize": "summary", "in short": "summary", "to conclude": "summary",
}
STOPWORDS = [
    "the", "a", "an", "is", "was", "were", "are", "be", "been", "being", "have", "has", "had", "do",
    "does", "did", "will", "would", "shall", "should", "may", "might", "can", "could", "to", "of",
    "in", "for", "on", "with", "at", "by", "from", "and", "or", "but", "not", "no", "so", "if",
    "as", "that", "this", "it", "he", "she", "they", "we", "you", "i", "me", "my", "his", "her",
    "its", "our", "their", "your", ".", ",", "!", "?", ";", ":", "'", '"', "(", ")", "-", "--",
]

# ---- Fixed values: patterns and phrases of the security overlay

CVE = r"(?i)CVE-\d{4}-\d{4,}"
CWE = r"(?i)CWE-\d{1,4}"
VERSION = r"\b\d+\.\d+(?:\.\d+)*(?:-[a-zA-Z0-9]+)?\b"
SEVERITY = r"(?i)\b(critical|high|medium|moderate|low|informational)\s*(?:severity|risk|impact)?\b"
CODE_ELEMENT = (
    r"(?i)\b(strcpy|strcat|sprintf|gets|scanf|memcpy|memmove|malloc|free|"
    r"printf|fprintf|eval|exec|system|popen|fork|[a-z_][a-z0-9_]*\(\))\b"
)
CVSS = r"(?i)\b(?:CVSS[:\s]*)?(\d+\.?\d*)\s*/\s*10\b"
SOFTWARE = [
    "apache", "apache http server", "nginx", "iis", "tomcat", "openssl", "openssh", "linux kernel",
    "windows", "macos", "mysql", "postgresql", "mongodb", "redis", "elasticsearch", "python", "java",
    "node.js", "php", "ruby", "docker", "kubernetes", "jenkins", "git", "gitlab", "chrome", "firefox",
    "safari", "edge", "wordpress", "drupal", "joomla", "spring", "django", "flask", "express",
    "log4j", "struts", "jackson", "fastjson",
]
ATTACK_VECTORS = {
    "remote": "remote", "remote attacker": "remote", "network": "network", "local": "local",
    "physical": "physical", "adjacent": "adjacent_network", "user-supplied input": "user_input",
    "user input": "user_input", "crafted request": "crafted_input",
    "malicious input": "malicious_input", "specially crafted": "crafted_input",
}
IMPACTS = {
    "arbitrary code execution": "rce", "remote code execution": "rce", "code execution": "rce",
    "denial of service": "dos", "denial-of-service": "dos", "information disclosure": "info_disclosure",
    "information leak": "info_disclosure", "data breach": "data_breach",
    "privilege escalation": "privesc", "authentication bypass": "auth_bypass",
    "sql injection": "sqli", "cross-site scripting": "xss", "path traversal": "path_traversal",
    "directory traversal": "path_traversal", "memory corruption": "memory_corruption",
    "use after free": "uaf", "use-after-free": "uaf", "double free": "double_free",
    "integer overflow": "integer_overflow", "heap overflow": "heap_overflow",
    "stack overflow": "stack_overflow",
}
VULNERABILITIES = {
    "buffer overflow": "buffer_overflow", "buffer over-read": "buffer_overread",
    "heap overflow": "heap_overflow", "stack overflow": "stack_overflow",
    "integer overflow": "integer_overflow", "format string": "format_string",
    "use after free": "use_after_free", "use-after-free": "use_after_free",
    "double free": "double_free", "null pointer dereference": "null_deref",
    "race condition": "race_condition", "command injection": "cmd_injection",
    "sql injection": "sqli", "cross-site scripting": "xss", "cross-site request forgery": "csrf",
    "server-side request forgery": "ssrf", "xml external entity": "xxe",
    "insecure deserialization": "deserialization", "path traversal": "path_traversal",
    "improper input validation": "input_validation", "improper access control": "access_control",
    "missing authentication": "missing_auth", "weak cryptography": "weak_crypto",
    "hardcoded credentials": "hardcoded_creds",
}
REMEDIATIONS = [
    ("upgrade", r"(?i)upgrad\w*\s+to\s+(?:version\s+)?(\S+)"),
    ("patch", r"(?i)patch\w*\s+(?:by\s+)?(?:applying|installing)"),
    ("update", r"(?i)(?:should|must|recommended)\s+(?:be\s+)?(?:updated|upgraded|patched)"),
    ("workaround", r"(?i)workaround"),
    ("mitigation", r"(?i)mitigat\w*"),
    ("disable_feature", r"(?i)disabl\w*\s+\w+"),
]
#: (relation, source domain types, target domain types), in order of precedence
RELATIONS = [
    ("AFFECTS", ["vulnerability_id"], ["software_product"]),
    ("CLASSIFIED_AS", ["vulnerability_id"], ["weakness_class"]),
    ("HAS_VERSION", ["software_product"], ["software_version"]),
    ("USES_FUNCTION", ["buffer_overflow", "use_after_free"], ["code_construct"]),
    ("CAUSES", ["remote", "user_input", "crafted_input"], ["rce", "dos", "info_disclosure"]),
    ("MITIGATED_BY", ["vulnerability_id"], ["upgrade", "patch", "update", "mitigation"]),
    ("THREATENS", ["remote", "network"], ["software_product"]),
]
CWE_OF_DOMAIN = {
    "buffer_overflow": "CWE-120", "use_after_free": "CWE-416", "integer_overflow": "CWE-190",
    "null_deref": "CWE-476", "sqli": "CWE-89", "xss": "CWE-79", "cmd_injection": "CWE-78",
    "path_traversal": "CWE-22", "race_condition": "CWE-362", "format_string": "CWE-134",
    "double_free": "CWE-415", "heap_overflow": "CWE-122", "stack_overflow": "CWE-121",
    "deserialization": "CWE-502", "ssrf": "CWE-918", "xxe": "CWE-611", "csrf": "CWE-352",
    "missing_auth": "CWE-306", "weak_crypto": "CWE-327", "hardcoded_creds": "CWE-798",
    "input_validation": "CWE-20", "access_control": "CWE-284",
}

# ---- Fixed values: code graph labels

#: the registry's maps between the two vocabularies
NODE_TYPE_OF_LABEL = {
    "METHOD": "DOCUMENT", "BLOCK": "PARAGRAPH", "METHOD_BLOCK": "SENTENCE", "CALL": "PREDICATE",
    "IDENTIFIER": "ENTITY", "LITERAL": "TOKEN", "CONTROL_STRUCTURE": "CLAUSE", "PARAM": "ARGUMENT",
    "LOCAL": "ARGUMENT", "FIELD_IDENTIFIER": "NOUN_PHRASE", "TYPE": "CONCEPT",
    "RETURN": "VERB_PHRASE", "UNKNOWN": "MENTION", "META_DATA": "TOPIC",
}
EDGE_TYPE_OF_LABEL = {
    "AST": "DEP", "CFG": "NEXT_TOKEN", "CFG_CROSS": "NEXT_SENT", "REACHING_DEF": "COREF",
    "CDG": "RST_RELATION", "ARGUMENT": "SRL_ARG", "CONTAINS": "CONTAINS", "BINDS_TO": "BELONGS_TO",
    "CALL": "ENTITY_REL", "DOMINATE": "DISCOURSE", "EVAL_TYPE": "SIMILARITY",
}
#: what a merge uses (a label missing here becomes TOKEN, or DEP for edges)
MERGE_NODE_TYPE = {
    "METHOD": "DOCUMENT", "BLOCK": "PARAGRAPH", "CALL": "PREDICATE", "IDENTIFIER": "ENTITY",
    "LITERAL": "TOKEN", "CONTROL_STRUCTURE": "CLAUSE", "PARAM": "ARGUMENT", "LOCAL": "ARGUMENT",
    "FIELD_IDENTIFIER": "NOUN_PHRASE", "TYPE": "CONCEPT", "RETURN": "VERB_PHRASE",
    "UNKNOWN": "MENTION", "META_DATA": "TOPIC",
}
MERGE_EDGE_TYPE = {
    "AST": "DEP", "CFG": "NEXT_TOKEN", "REACHING_DEF": "COREF", "CDG": "RST_RELATION",
    "ARGUMENT": "SRL_ARG", "CONTAINS": "CONTAINS",
}

# ---- Fixed values: names and sentences that exports and metadata carry

FORMAT_TYPE, FORMAT_LABEL = "TPG", "tpg"
MERGED_SOURCE = "tpg+cpg_merged"
FLOW_SENTENCE = "Text-described attack vector '%s' maps to CPG data flow reaching %s"

# ---- Patterns of the rule annotator (our own; they read the same in Java and RE2)

PARAGRAPH_BREAK = r"\n\s*\n"  # a fixed value
SENTENCE = r"[^.!?]+(?:[.!?]+[^\s.!?][^.!?]*)*[.!?]*|[.!?]+"
TOKEN = r"[\p{L}\p{N}_]+(?:['’-][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\s\x{b}\x{1c}-\x{1f}\x{85}\p{Z}]"

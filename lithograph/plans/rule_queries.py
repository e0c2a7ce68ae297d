"""Review rules over documents, pages and a Java class for each part, all through one engine."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lithograph.operators import rules as E
from lithograph.plans.tables import Catalog, table

catalog = Catalog()

# Patterns that decide what a rule finds, and the titles of findings.  Those of the Java rules must be these for equal results.
_CREDENTIAL = r'(?i)(?:password|passwd|secret|api[_-]?key|token|credential|auth)\s*=\s*"[^"]{4,}"'
_SECURITY_WORD = r"(?i)(?:token|session|nonce|salt|key|secret|otp|password)"
_MAGIC_STRING = r'(?:return|=|\+=)\s*"([A-Za-z][^"]{5,})"'
_EXEMPT = ("Exception", "Error", "Builder", "DTO", "Dto", "Request", "Response", "Event", "ArrayList", "HashMap", "HashSet", "LinkedList", "LinkedHashMap", "StringBuilder", "StringBuffer", "Random", "Date", "BigDecimal", "BigInteger", "LocalDate", "LocalDateTime", "ZonedDateTime")
_FINAL = r"(?:static\s+)?final\s+\w+\s+[A-Z_][A-Z0-9_]*\s*="

TEXT_RULES = (
    E.Rule("SEC-002", "security", "critical", "Hardcoded credential in {unit}", _CREDENTIAL, needs='"'),
    E.Rule("TXT-002", "security", "medium", "Security word in {unit}", _SECURITY_WORD),
    E.Rule("TXT-003", "maintainability", "low", "Quoted text in {unit}", _MAGIC_STRING, needs='"'),
    E.Rule("TXT-004", "patterns", "low", "Primitive parameter in {unit}", r"(?:int|long|double|float|boolean|short|byte|char)\s+[A-Za-z0-9_]+", least=2),
    E.Rule("PII-001", "privacy", "high", "E-mail address in {unit}", r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[a-z]{2,}", needs="@"),
    E.Rule("PII-002", "privacy", "medium", "IPv4 literal in {unit}", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    E.Rule("TXT-001", "maintainability", "info", "{hits} multi-digit number(s) in {unit}", r"[0-9]{5,}"),
)

JAVA_RULES = (
    E.Rule("SOLID-O001", "solid", "medium", "OCP: {unit} uses {hits} instanceof checks", r"\binstanceof\s+([A-Z][a-zA-Z0-9_]+)", least=3, needs="instanceof"),
    E.Rule("SOLID-O002", "solid", "low", "OCP: {unit} has a long else-if chain ({hits} branches)", r"\belse\s+if\s*\(", least=4, needs="else"),
    E.Rule("SOLID-L001", "solid", "high", "LSP Violation: {unit} throws UnsupportedOperationException", r"throw\s+new\s+(?:UnsupportedOperationException|NotImplementedException)", needs="throw"),
    E.Rule("SOLID-D002", "solid", "low", "DIP: {unit} instantiates {hits} concrete class(es)", r"=\s*new\s+([A-Z][a-zA-Z0-9_]+)\s*\(", least=2, distinct=True, group=1, needs="new", exempt=_EXEMPT),
    E.Rule("SEC-001", "security", "critical", "SQL Injection risk in {unit}", r'(?i)(?:query|sql|hql|jpql|nativeQuery|createQuery|createNativeQuery)[^;]*?"[^"]*"\s*\+', needs='"'),
    E.Rule("SEC-002", "security", "critical", "Hardcoded credential in {unit}", _CREDENTIAL, needs='"'),
    E.Rule("SEC-004", "security", "high", "Sensitive data logging in {unit}", r"(?i)(?:log|logger|LOG)\s*\.\s*(?:info|debug|warn|error|trace)\s*\([^)]*(?:password|passwd|secret|token|credential|credit[_-]?card)|System\.out\.(?:print|println)\s*\([^)]*(?:password|passwd|secret|token|credential)"),
    E.Rule("SEC-005", "security", "high", "Weak cryptographic algorithm in {unit}: {values}", r'(?i)(?:getInstance|getMessageDigest)\s*\(\s*"(?:MD5|SHA-?1|DES|3DES|RC4|RC2)"', distinct=True, needs='"'),
    E.Rule("SEC-006", "security", "medium", "Insecure random in {unit}", r"new\s+java\.util\.Random\s*\(\s*\)|new\s+Random\s*\(\s*\)", requires=_SECURITY_WORD, needs="Random"),
    E.Rule("SEC-007", "security", "high", "Unsafe deserialization in {unit}", r"new\s+ObjectInputStream\s*\(|\.readObject\s*\("),
    E.Rule("SEC-008", "security", "high", "Path traversal risk in {unit}", r"(?i)new\s+(?:File|FileInputStream|FileOutputStream|Path)\s*\([^)]*(?:getParameter|getPathVariable|requestParam|param)"),
    E.Rule("SEC-009", "security", "info", "No method-level security annotation in {unit}", r"@(?:RestController|Controller)\b", unless=r"@(?:PreAuthorize|PostAuthorize|Secured|RolesAllowed|PermitAll|DenyAll)", needs="@"),
    E.Rule("SEC-010", "security", "high", "CSRF protection disabled in {unit}", r"\.csrf\s*\(\s*\w*\s*->\s*\w+\.disable\s*\(\s*\)", needs="csrf"),
    E.Rule("PERF-001", "performance", "high", "N+1 query risk in {unit}", r"(?s)\b(?:for|while)\b[^{]*\{[^}]*(?:repository|repo|dao|Repo|Repository|DAO)\s*\.\s*\w+\s*\("),
    E.Rule("PERF-002", "performance", "low", "Missing @Transactional(readOnly=true) on read methods in {unit}", r"(?:public|protected)\s+(?:List|Optional|Page|Set|Collection|Stream|[A-Z]\w+)\s+(?:find|get|list|fetch|search|load|query)\w*\s*\(", requires=r"@(?:Service|Component)\b", unless=r"readOnly\s*=\s*true|@Transactional\b"),
    E.Rule("PERF-003", "performance", "medium", "Unbounded findAll() in {unit}", r"\.\s*findAll\s*\(\s*\)", unless=r"Pageable|PageRequest|Page<", needs="findAll"),
    E.Rule("PERF-004", "performance", "medium", "EAGER fetch type in {unit} ({hits} relation(s))", r"@(?:OneToMany|ManyToMany|ManyToOne|OneToOne)\s*\([^)]*fetch\s*=\s*FetchType\.EAGER", needs="EAGER"),
    E.Rule("PERF-005", "performance", "low", "String concatenation in loop in {unit}", r'(?s)(?:for|while)\b[^{]*\{[^}]*(?:String\s+\w+|[a-z]\w*)\s*\+=\s*"', needs="+="),
    E.Rule("PERF-006", "performance", "info", "Consider @Cacheable on expensive methods in {unit}", r"(?:public|protected)\s+[A-Z\w<>\[\]]+\s+(?:calculate|compute|build|generate|process|aggregate|summarise|summarize)\w*\s*\(", unless=r"@Cacheable\b"),
    E.Rule("PERF-007", "performance", "medium", "Coarse-grained synchronization in {unit}", r"public\s+synchronized\s+\w", needs="synchronized"),
    E.Rule("PERF-008", "performance", "low", "Async-named methods lack @Async in {unit}", r"(?:public|protected)\s+\w[\w<>\[\]]*\s+(?:sendAsync|processAsync|handleAsync|\w+Async|async\w+)\s*\(", unless=r"@Async\b"),
    E.Rule("MAINT-002", "maintainability", "medium", "Deep nesting in {unit} ({hits} deeply nested line(s))", r"(?m)^(?:    ){5}|\t{5}", least=3),
    E.Rule("MAINT-003b", "maintainability", "low", "Magic strings in {unit}", _MAGIC_STRING, least=3, distinct=True, group=1, needs='"', silent=("http",)),
    E.Rule("MAINT-004", "maintainability", "high", "Empty catch block in {unit} ({hits} occurrence(s))", r"catch\s*\([^)]+\)\s*\{\s*(?://[^\n]*)?\s*\}", needs="catch"),
    E.Rule("MAINT-006", "maintainability", "low", "Single-character variable names in {unit}: {values}", r"(?:int|String|long|boolean|double|float|Object|var)\s+([a-wz])\b\s*[=;]", least=3, distinct=True, group=1),
    E.Rule("DEBT-001", "tech_debt", "low", "Technical debt: {hits} TODO/FIXME/HACK comment(s) in {unit}", r"(?i)//\s*(?:TODO|FIXME|HACK|XXX|BUG|WORKAROUND)[^\n]*", needs="//", worse=(5, "medium")),
    E.Rule("DEBT-002", "tech_debt", "medium", "{unit} has {hits} @Deprecated element(s)", r"@Deprecated\b", needs="@Deprecated"),
    E.Rule("DEBT-006", "tech_debt", "high", "Deprecated Spring MVC pattern in {unit}", r"(?:extends\s+(?:SimpleFormController|AbstractController|MultiActionController)|springMVC|spring-webmvc\s+3\.|org\.springframework\.web\.servlet\.mvc\.AbstractController)"),
    E.Rule("DEBT-009", "tech_debt", "high", "System.exit() call in non-main class {unit}", r"\bSystem\.exit\s*\(", unless=r"public\s+static\s+void\s+main\s*\(", needs="System.exit"),
    E.Rule("PAT-001", "patterns", "info", "Singleton pattern in {unit}", r"private\s+static\s+(?:volatile\s+)?(?:final\s+)?[A-Z]\w+\s+(?:instance|INSTANCE|singleton)\b", requires=r"public\s+static\s+\w+\s+getInstance\s*\("),
    E.Rule("PAT-002", "patterns", "info", "Factory Method pattern in {unit}", r"public\s+static\s+[A-Z]\w+\s+(?:create|build|of|from|newInstance|make)\w*\s*\("),
    E.Rule("PAT-003", "patterns", "info", "Builder pattern in {unit}", r"class\s+\w*Builder\b|public\s+\w*Builder\s+\w+\s*\(", needs="Builder"),
    E.Rule("PAT-004", "patterns", "info", "Observer/Event pattern in {unit}", r"@(?:EventListener|ApplicationListener|KafkaListener|RabbitListener)\b|(?:applicationEventPublisher|eventPublisher)\s*\.\s*publishEvent\s*\("),
    E.Rule("ANTI-002", "patterns", "high", "Service Locator anti-pattern in {unit}", r"(?i)(?:applicationContext|ctx|context)\s*\.\s*getBean\s*\("),
    E.Rule("ANTI-006", "patterns", "low", "Complex inheritance in {unit}", r"\bextends\s+([A-Z]\w+)", least=2, needs="extends"),
)

#: A small corpus of our own: (class, content), with positive and negative rows for the Java rules.
JAVA = (
    ("ShapeArea", "class ShapeArea { double area(Object o) { if (o instanceof Circle) { return 1; } else if (o instanceof Square) { return 2; } else if (o instanceof Ring) { return 3; } else if (o == null) { return 0; } else if (o.hashCode() > 3) { return 4; } return 5; } }"),
    ("FrozenList", "class FrozenList extends Base { class In extends Other {} public void add(Item i) { throw new UnsupportedOperationException(); } }"),
    ("ReportDao", 'class ReportDao { List all(String who) { String sql = "select * from t where n = " + who; return run(sql); } }'),
    ("Vault", 'class Vault { String password = "hunter22"; void show() { log.info("secret " + password); } }'),
    ("Digest", 'class Digest { byte[] of(byte[] b) { return MessageDigest.getInstance("MD5").digest(b); } byte[] ok(byte[] b) { return MessageDigest.getInstance("SHA-256").digest(b); } }'),
    ("TokenMaker", "class TokenMaker { String token() { return new Random().nextInt() + x; } }"),
    ("Dice", "class Dice { int roll() { return new Random().nextInt(6); } }"),
    ("Thaw", "class Thaw { Object read(InputStream s) { return new ObjectInputStream(s).readObject(); } }"),
    ("Files", 'class Files { File open(Request r) { return new File(r.getParameter("name")); } }'),
    ("OrderApi", "@RestController class OrderApi { private OrderRepository repository; List all() { return repository.findAll(); } }"),
    ("SafeApi", "@RestController class SafeApi { @PreAuthorize(\"x\") Page<Order> all(Pageable p) { return repository.findAll(); } }"),
    ("WebSecurity", "class WebSecurity { void configure(Http h) { h.csrf(c -> c.disable()); } }"),
    ("Loader", "@Service class Loader { public Order findOne(long id, int a, int b, boolean c) { for (Item i : items) { repository.findById(i); } return null; } }"),
    ("Owner", "class Owner { @OneToMany(fetch = FetchType.EAGER) List pets; }"),
    ("Joiner", 'class Joiner { String all(List l) { String s = ""; for (Object o : l) { s += "x"; } return s; } public synchronized void go() {} }'),
    ("Stats", "class Stats { public Total computeTotals() { return null; } public void sendAsync(Mail m) {} }"),
    ("Cached", "class Cached { @Cacheable public Total computeTotals() { return null; } @Async public void sendAsync(Mail m) {} }"),
    ("Deep", "class Deep {\n                    a();\n                    b();\n                    c();\n}"),
    ("Quiet", "class Quiet { void go() { try { run(); } catch (Exception e) { } } void fine() { try { run(); } catch (Exception e) { log.warn(e); } } }"),
    ("Short", "class Short { void go() { int a = 1; String b; long c = 2; } }"),
    ("Later", "class Later {\n// TODO one\n// FIXME two\n@Deprecated void old() {} String host = \"10.0.0.1:8080\"; int port = 8081; }"),
    ("OldForm", "class OldForm extends SimpleFormController { void stop() { System.exit(1); } }"),
    ("Main", "class Main { public static void main(String[] a) { System.exit(0); } }"),
    ("One", "class One { private static One instance; public static One getInstance() { return instance; } public static One createOne() { return null; } }"),
    ("CarBuilder", "class CarBuilder { public CarBuilder doors(int n) { return this; } }"),
    ("Listener", "class Listener { @EventListener void on(Event e) { eventPublisher.publishEvent(e); Object o = context.getBean(\"x\"); } }"),
    ("Maker", "class Maker { void make() { a = new Engine(); b = new Wheel(); } }"),
    ("Plain", "class Plain { private final Engine engine; Plain(Engine engine) { this.engine = engine; } }"),
    ("Fields", "class Fields {\n    @Autowired\n    private Engine engine;\n    public int speed;\n    public static final int MOST = 99;\n}"),
    ("Numbers", 'class Numbers {\n  int[] a = {12, 34, 56, 78};\n  static final int MAX = 999;\n  String u = "https://api.vendor.io/v1"; String l = "http://localhost:80/x";\n}'),
    ("Fine", 'class Fine { String u = "http://localhost:80/x"; }'),
    ("Port", "interface Port { " + " ".join(f"void do{x}(int n);" for x in "ABCDEFGHIJKL") + " }"),
    ("Words", 'class Words { String a() { return "one and two"; } String b() { return "three four"; } String c = "five six"; String d = "http://not.counted"; }'),
    ("Debts", "class Debts {\n// TODO a\n// FIXME b\n// HACK c\n// XXX d\n// BUG e\n}"),
    ("Lists", "class Lists { void make() { a = new ArrayList(); b = new HashMap(); c = new Engine(); } }"),
    ("Api", "@RestController class Api { public Order make(@RequestBody Order o) { return o; } public Order put(@Valid @RequestBody Order o, @RequestBody Note n) { return o; } }"),
    ("GoodApi", "@RestController class GoodApi { public Order put(@Valid @RequestBody Order o) { return o; } }"),
    ("Wide", "class Wide { public void go(int a, int b, long c, String d, double e, boolean f) {} private int one(int a) { return a; } }"),
    ("Silent", "class Silent {" + " int x;" * 3 + "}" + "\nint y;" * 60),
    ("Spoken", "class Spoken {\n/** why */\npublic int a() { return 1; }\n/** why */\npublic int b() { return 2; }\n}" + "\n// note" * 60),
    ("Mute", "class Mute { public int a() { return 1; } public int b() { return 2; } }"),
)


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _corpus_sql() -> str:
    """A unit for each part: one of the classes above under a name of its own, and a comment that names the part."""
    rows = ", ".join(f"({i}, {_quote(c)}, {_quote(t)})" for i, (c, t) in enumerate(JAVA))
    return f"(SELECT v.name || '_' || p_partkey AS unit, v.content || chr(10) || '// part ' || p_name AS content FROM part JOIN (VALUES {rows}) v(i, name, content) ON p_partkey % {len(JAVA)} = v.i)"


def _found_sql(r) -> str:
    content = "content"
    if r.skip_lines:
        content = f"array_to_string(list_filter(string_split(content, chr(10)), lambda x: NOT regexp_matches(x, {_quote(r.skip_lines)})), chr(10))"
    found = PLAIN_SQL[r.rule_id].format(content=content) if r.rule_id in PLAIN_SQL and "(?" in r.pattern and r in LOOKAROUND_RULES else f"regexp_extract_all({content}, {_quote(r.pattern)}, {r.group})"
    if r.exempt:
        found = f"list_filter({found}, lambda x: NOT regexp_matches(x, {_quote('(?:' + '|'.join(r.exempt) + ')$')}))"
    if r.silent:
        found = f"list_filter({found}, lambda x: NOT regexp_matches(x, {_quote('^(?:' + '|'.join(r.silent) + ')')}))"
    return f"list_filter({found}, lambda x, i: list_position({found}, x) = i)" if r.distinct else found


def findings_sql(units: str, rules) -> str:
    parts = []
    for seq, r in enumerate(rules):
        title = " || ".join({"{unit}": "unit", "{hits}": "hits", "{values}": "array_to_string(found, ', ')"}.get(x, _quote(x)) for x in re.split(r"(\{\w+\})", r.title) if x)
        hits = f"least(len(found), {r.most})" if r.most else "len(found)"
        where = f"n >= {r.least}"
        if r.requires:
            where += f" AND regexp_matches(content, {_quote(r.requires)})"
        if r.unless:
            where += f" AND NOT regexp_matches(content, {_quote(r.unless)})"
        severity = f"CASE WHEN n >= {r.worse[0]} THEN '{r.worse[1]}' ELSE '{r.severity}' END" if r.worse else f"'{r.severity}'"
        parts.append(f"SELECT unit, {seq} AS rule_seq, '{r.rule_id}' AS rule_id, '{r.category}' AS category, {severity} AS severity, {title} AS title, hits, found[1][1:500] AS evidence FROM (SELECT unit, content, found, len(found) AS n, CAST({hits} AS INT) AS hits FROM (SELECT unit, content, {_found_sql(r)} AS found FROM units)) WHERE {where}")
    return f"WITH units AS MATERIALIZED ({units}), found AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")"


#: Rules whose patterns look around.  Fixed values, as above.
LOOKAROUND_RULES = (
    E.Rule("SOLID-D001", "solid", "medium", "DIP/Best Practice: {unit} uses @Autowired field injection", r"@Autowired\s*\n\s*(?:private|protected|public)\s+(?!static)", needs="@Autowired"),
    E.Rule("SOLID-I001", "solid", "medium", "ISP Violation: {unit} declares {hits} methods", r"(?m)(?:public\s+)?(?:default\s+)?(?!void\s+\w+\s*=)[a-zA-Z_$<>\[\]]+\s+\w+\s*\([^)]*\)\s*(?:throws[^;{]+)?[;{]", least=11, requires=r"\binterface\s+\w"),
    E.Rule("MAINT-003", "maintainability", "low", "Magic numbers in {unit} ({hits} distinct value(s))", r"(?<![A-Z_=])\b(?!0\b|1\b)(?:\d{2,}|[02-9]\.\d+)\b(?!\s*[;,)]?\s*;?\s*//)", least=4, distinct=True, most=8, skip_lines=_FINAL + r"|^\s*//"),
    E.Rule("MAINT-010", "maintainability", "medium", "Public mutable fields in {unit} ({hits} field(s))", r"(?m)^\s*public\s+(?!static\s+final)(?!class|interface|enum|@interface|void)[A-Za-z_$][\w<>\[\]]*\s+[a-z]\w*\s*[=;]", needs="public"),
    E.Rule("DEBT-005", "tech_debt", "medium", "Hardcoded URL/IP/port in {unit}", r'"https?://(?!localhost|127\.0\.0\.1|example\.com|schemas\.)[^"]{5,}"|"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d+)?"|(?:port|PORT)\s*=\s*(?:80[89]\d|90\d{2}|[1-9]\d{4})\b'),
)

#: The same matches without looking around, for the other engine.
PLAIN_SQL = {
    "SOLID-D001": r"list_filter(regexp_extract_all({content}, '@Autowired\s*\n\s*(?:private|protected|public)\s+(?:static)?'), lambda x: NOT ends_with(x, 'static'))",
    "SOLID-I001": r"regexp_extract_all({content}, '(?m)(?:public\s+)?(?:default\s+)?[a-zA-Z_$<>\[\]]+\s+\w+\s*\([^)]*\)\s*(?:throws[^;{{]+)?[;{{]')",
    "MAINT-003": r"regexp_extract_all({content}, '(?:^|[^A-Za-z0-9_=])((?:[0-9]{{2,}}|[2-9]\.[0-9]+))\b', 1)",
    "MAINT-010": r"list_filter(regexp_extract_all({content}, '(?m)^\s*public\s+[A-Za-z_$][\w<>\[\]]*\s+[a-z]\w*\s*[=;]'), lambda x: NOT regexp_matches(x, '^\s*public\s+(?:static\s+final|class|interface|enum|void)'))",
    "DEBT-005": r"""list_filter(regexp_extract_all({content}, '"https?://[^"]{{5,}}"|"\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}(?::\d+)?"|(?:port|PORT)\s*=\s*(?:80[89]\d|90\d{{2}}|[1-9]\d{{4}})\b'), lambda x: NOT regexp_matches(x, '^"https?://(?:localhost|127\.0\.0\.1|example\.com|schemas\.)'))""",
}


_DOCS = "SELECT CAST(doc_id AS VARCHAR) AS unit, text AS content FROM documents"
_PAGES = "SELECT CAST(page_id AS VARCHAR) AS unit, html AS content FROM pages"
_JAVA = f"SELECT * FROM {_corpus_sql()}"
_ORD = "list_position(['critical', 'high', 'medium', 'low', 'info'], severity)"


def java_units(spark, sf):
    """(class_name, content): a class for each part."""
    classes = F.broadcast(spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(JAVA)], "i long, name string, text string"))
    rows = table(spark, sf, "part").join(classes, F.col("p_partkey") % len(JAVA) == F.col("i"))
    return rows.select(F.concat("name", F.lit("_"), "p_partkey").alias("class_name"), F.concat("text", F.lit("\n// part "), "p_name").alias("content"))


def document_units(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("class_name"), F.col("text").alias("content"))


def _doc_findings(spark, sf):
    return E.findings(document_units(spark, sf), TEXT_RULES)


def _java_findings(spark, sf):
    return E.findings(java_units(spark, sf), JAVA_RULES)


@catalog.add(findings_sql(_DOCS, TEXT_RULES) + " SELECT rule_id, severity, title, unit, hits FROM found")
def rule_findings(spark, sf):
    return _doc_findings(spark, sf).select("rule_id", "severity", "title", "unit", "hits")


@catalog.add(findings_sql(_PAGES, TEXT_RULES) + " SELECT rule_id, severity, title, unit, hits FROM found")
def rule_findings_pages(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("class_name"), F.col("html").alias("content"))
    return E.findings(pages, TEXT_RULES).select("rule_id", "severity", "title", "unit", "hits")


@catalog.add(findings_sql(_JAVA, JAVA_RULES) + " SELECT rule_id, category, severity, title, unit, hits FROM found")
def rule_findings_java(spark, sf):
    return _java_findings(spark, sf).select("rule_id", "category", "severity", "title", "unit", "hits")


_PIVOT = " SELECT category, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in E.SEVERITIES) + " FROM found GROUP BY category"


@catalog.add(findings_sql(_DOCS, TEXT_RULES) + _PIVOT)
def rule_category_pivot(spark, sf):
    return E.category_summary(_doc_findings(spark, sf))


@catalog.add(findings_sql(_JAVA, JAVA_RULES) + _PIVOT)
def rule_category_pivot_java(spark, sf):
    return E.category_summary(_java_findings(spark, sf))


@catalog.add(findings_sql(_DOCS, TEXT_RULES) + " SELECT rule_id, source, arg_min(unit, lpad(unit, 20, '0')) AS unit FROM found JOIN documents ON CAST(doc_id AS VARCHAR) = unit GROUP BY rule_id, source")
def rule_dedup(spark, sf):
    """One finding for each rule and set of affected classes (here the source of the document)."""
    sources = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("unit"), "source", "doc_id")
    found = _doc_findings(spark, sf).join(sources, "unit").select("rule_id", "rule_seq", F.lpad("unit", 20, "0").alias("unit"), F.array("source", "source").alias("affected"))
    return E.dedup(found).select("rule_id", F.col("affected")[0].alias("source"), F.ltrim(F.col("unit"), F.lit("0")).alias("u")).select("rule_id", "source", F.when(F.col("u") == "", "0").otherwise(F.col("u")).alias("unit"))


@catalog.add(findings_sql(_JAVA, JAVA_RULES) + f""", one AS (SELECT *, row_number() OVER (PARTITION BY rule_id, title[1:60] ORDER BY {_ORD}, rule_seq, unit) AS k FROM found)
SELECT rule_id, '[' || upper(severity) || '] ' || title AS issue FROM one WHERE k = 1 ORDER BY {_ORD}, rule_seq, unit LIMIT 5""")
def rule_top_issues(spark, sf):
    return E.top_issues(_java_findings(spark, sf))


_SCORE = " , s AS (SELECT round(greatest(0, 100 - sum(CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 5 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) / greatest((SELECT count(*) FROM units) / 10.0, 1.0)), 2) AS score FROM found)"
_GRADE = " SELECT score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 45 THEN 'D' ELSE 'F' END AS grade FROM s"


@catalog.add(findings_sql(_DOCS, TEXT_RULES) + _SCORE + _GRADE)
def rule_quality_score(spark, sf):
    units = document_units(spark, sf)
    return E.quality_score(_doc_findings(spark, sf), units.count())


@catalog.add(findings_sql(_JAVA, JAVA_RULES) + _SCORE + _GRADE)
def rule_grade(spark, sf):
    return E.quality_score(_java_findings(spark, sf), java_units(spark, sf).count())


@catalog.add(findings_sql(_JAVA, JAVA_RULES) + """ SELECT category, count(*) AS total, 10 * count(*) FILTER (WHERE severity = 'critical') + 5 * count(*) FILTER (WHERE severity = 'high') + 2 * count(*) FILTER (WHERE severity = 'medium') AS priority
FROM found GROUP BY category ORDER BY priority DESC, category LIMIT 3""")
def rule_exec_top3(spark, sf):
    return E.executive_top(_java_findings(spark, sf))


@catalog.add("""SELECT unit, array_to_string(list_slice(list(i ORDER BY i), 1, 10), ',') AS lines FROM (
SELECT CAST(doc_id AS VARCHAR) AS unit, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE regexp_matches(x, '[0-9]{5,}') GROUP BY unit""")
def rule_line_numbers(spark, sf):
    found = E.line_numbers(document_units(spark, sf), "class_name", "content", "[0-9]{5,}")
    return found.select(F.col("class_name").alias("unit"), F.array_join("lines", ",").alias("lines"))


@catalog.add("""SELECT unit, CAST(len(list_filter(l, lambda x: starts_with(trim(x), '//') OR starts_with(trim(x), '*') OR starts_with(trim(x), '/*'))) AS BIGINT) AS comments, CAST(len(l) AS BIGINT) AS loc
FROM (SELECT unit, string_split(content, chr(10)) AS l FROM """ + _corpus_sql() + ")")
def rule_comment_ratio(spark, sf):
    lines = F.split("content", "\n")
    comment = F.filter(lines, lambda x: F.trim(x).startswith("//") | F.trim(x).startswith("*") | F.trim(x).startswith("/*"))
    return java_units(spark, sf).select(F.col("class_name").alias("unit"), F.size(comment).cast("long").alias("comments"), F.size(lines).cast("long").alias("loc"))


@catalog.add(findings_sql(_DOCS, TEXT_RULES) + " SELECT rule_id, arg_min(unit, lpad(CAST(100000 - hits AS VARCHAR), 6, '0') || lpad(unit, 20, '0')) AS unit, max(hits) AS hits FROM found GROUP BY rule_id")
def rule_worst_offender(spark, sf):
    return _doc_findings(spark, sf).groupBy("rule_id").agg(F.min_by("unit", F.struct(-F.col("hits"), F.lpad("unit", 20, "0"))).alias("unit"), F.max("hits").alias("hits"))


@catalog.add("""WITH n AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS unit FROM part), t AS (SELECT DISTINCT p_name AS name FROM part) SELECT unit FROM n WHERE NOT EXISTS (SELECT 1 FROM t WHERE contains(substr(name, strpos(name, ' ') + 1), unit))""")
def rule_missing_counterpart(spark, sf):
    """First words of part names that the rest of no name holds: an anti join with an inexact match, without a cross join."""
    names = table(spark, sf, "part").select("p_name").distinct()
    units = names.select(F.split("p_name", " ")[0].alias("unit")).distinct()
    rest = names.select(F.expr("substr(p_name, instr(p_name, ' ') + 1)").alias("rest")).distinct()
    return units.join(E.containing(units, rest, "unit", "rest"), "unit", "left_anti")


@catalog.add(findings_sql(_JAVA, LOOKAROUND_RULES) + " SELECT rule_id, severity, title, unit, hits FROM found")
def rule_findings_lookaround(spark, sf):
    return E.findings(java_units(spark, sf), LOOKAROUND_RULES).select("rule_id", "severity", "title", "unit", "hits")


@catalog.add(findings_sql(_JAVA, E.chosen(JAVA_RULES, "security, tech_debt")) + " SELECT rule_id, severity, unit FROM found WHERE severity IN ('critical', 'high')")
def rule_findings_switched(spark, sf):
    """Some analyzers only, and their grave findings."""
    found = E.findings(java_units(spark, sf), E.chosen(JAVA_RULES, "security, tech_debt"))
    return E.with_severity(found, "critical", "high").select("rule_id", "severity", "unit")


_PLACED = ", placed AS (SELECT *, CAST(row_number() OVER (ORDER BY list_position(['solid', 'security', 'performance', 'maintainability', 'duplicates', 'tech_debt', 'patterns'], category), rule_seq, unit) AS BIGINT) AS place FROM found)"


@catalog.add(findings_sql(_JAVA, JAVA_RULES) + _PLACED + " SELECT place, category, rule_id, unit FROM placed")
def rule_findings_ordered(spark, sf):
    """The findings of all analyzers in their order, numbered."""
    from lithograph.functions.order import numbered

    return numbered(_java_findings(spark, sf).select("category", "rule_seq", "rule_id", "unit"), [E.analyzer_order(), F.col("rule_seq"), F.col("unit")]).drop("rule_seq")


@catalog.add(findings_sql(_JAVA, JAVA_RULES) + f" SELECT rule_id, severity, unit FROM found WHERE severity IN ('critical', 'high') ORDER BY {_ORD}, rule_seq, unit LIMIT 15")
def rule_grave_15(spark, sf):
    grave = E.with_severity(_java_findings(spark, sf), "critical", "high")
    return grave.orderBy(E.severity_order(), "rule_seq", "unit").limit(15).select("rule_id", "severity", "unit")

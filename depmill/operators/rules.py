"""The table of line rules: what the line checks look for.

A rule holds for a line that matches ``pattern`` and all of ``also``, and none of ``never``, in a file that matches
``files``. ``frames`` look at the lines around a hit, joined by line ends: with all patterns of a frame present the rule is
off, or, with ``needed``, only then on. ``worse`` names what raises a medium finding to high.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Frame:
    before: int
    after: int
    patterns: tuple[str, ...]
    needed: bool = False


@dataclass(frozen=True)
class Rule:
    check: str
    kind: str
    severity: str
    title: str
    pattern: str
    also: tuple[str, ...] = ()
    never: tuple[str, ...] = ()
    files: str = ""
    frames: tuple[Frame, ...] = ()
    worse: str = ""


#: Titles, classes, severities and patterns of the line checks, and the names that they read as input, roles
#: of files, and files and lines that are passed over. They must equal those of the tool whose findings are reproduced.
SKIPPED_DIRS = ("node_modules/", "dist/", ".git/", ".wrangler/")
TEST_WORDS = ("test", "spec", "fixture", "mock", "__tests__", "__mocks__")
REVIEWED = "security-reviewed"
COMMENTS = {"injection": ("//", "#", "*"), "frontend": ("//", "{/*")}
OTHER_COMMENTS = ("//", "#")
INJECTION_INPUT = r"(?i)(?:input|user|name|path|query|branch|hash|cmd|command|req\.|params|body|args|url|dir|file|subdirectory)"
PATH_INPUT = r"(?i)(?:req\.|params|query|body|input|path|dir|subdirectory|file|userInput|fileName|filePath)"
LOG_INPUT = r"(?i)(?:input|user|name|path|query|param|request|body|args|url)"
ROUTE_FILES = r"(?i)(?:route|api/|mcp/|handler|controller)"
AUTH_FILES = r"(?i)(?:auth|session|token|jwt|oauth|login|passport)"
CRYPTO_FILES = r"(?i)(?:auth|password|crypto|hash|session|token|jwt)"
FRONTEND_FILES = r"\.(?:tsx|jsx|html)$"
FIXED_OUTPUT = r"""(?:output|outPath|outFile|dest|target|docPath).*\.(?:md|json|html|ts|js)['"]|['"][^'"]+\.(?:md|json|html|ts|js)['"]"""
SAFE_ARGUMENTS = r"(?i)(?:grammar|wasm|wasmPath|wasmFile|grammars)"
PHP_PASSWORD = r"(?i)password|passwd|pass|pwd"
INJECTION = (
    ("shell-injection", "high", "Shell Injection via execSync template literal", r"execSync\s*\(\s*`[^`]*\$\{"),
    ("shell-injection", "high", "Shell Injection via exec template literal", r"exec\s*\(\s*`[^`]*\$\{"),
    ("shell-injection", "medium", "Potentially unsafe spawn with user-controlled arguments", r"(?i)spawn\s*\([^)]*,\s*\[[^\]]*(?:input|user|path|query|cmd|command|args|req\.|params|body)"),
    ("shell-injection", "high", "Python shell=True in subprocess.run", r"subprocess\.run\s*\([^)]*shell\s*=\s*True"),
    ("shell-injection", "high", "Python os.system() call", r"os\.system\s*\("),
    ("code-injection", "high", "eval() usage detected", r"eval\s*\("),
    ("code-injection", "high", "new Function() constructor", r"new\s+Function\s*\("),
    ("code-injection", "high", "Go SQL injection via fmt.Sprintf", r"(?i)fmt\.Sprintf\s*\([^)]*(?:SELECT|INSERT|UPDATE|DELETE)"),
    ("code-injection", "high", "Go SQL injection via db.Query with fmt.Sprintf", r"db\.Query\s*\(\s*fmt\.Sprintf"),
    ("code-injection", "high", "Java SQL injection via string concatenation", r"""(?i)(?:executeQuery|executeUpdate|execute)\s*\(\s*["']?\s*(?:SELECT|INSERT|UPDATE|DELETE)\b[^"']*["']?\s*\+"""),
    ("shell-injection", "high", "Java command injection via Runtime.exec", r"Runtime\.getRuntime\(\)\.exec\s*\("),
    ("shell-injection", "medium", "Java command injection via ProcessBuilder with user input", r"(?i)new\s+ProcessBuilder\s*\([^)]*(?:input|user|param|query|request|body|arg)"),
    ("code-injection", "high", "Java insecure deserialization via ObjectInputStream", r"new\s+ObjectInputStream\s*\("),
    ("code-injection", "medium", "Java XML External Entity (XXE) risk", r"DocumentBuilderFactory\.newInstance\(\)"),
    ("code-injection", "medium", "Spring Security CSRF protection disabled", r"\.csrf\(\)\s*\.\s*disable\(\)"),
    ("code-injection", "high", "Spring Security permitAll on sensitive path", r"(?i)\.permitAll\(\).*(?:admin|manage|delete|config|setting)"),
    ("shell-injection", "high", "C++ buffer overflow risk: unsafe string function", r"\b(?:strcpy|strcat|sprintf|gets)\s*\("),
    ("shell-injection", "high", "C++ format string vulnerability", r'printf\s*\(\s*(?!")[a-zA-Z_]\w*'),
    ("shell-injection", "high", "C++ command injection via system()", r'\bsystem\s*\(\s*(?!")[a-zA-Z_]\w*'),
    ("shell-injection", "high", "C++ command injection via popen()", r'\bpopen\s*\(\s*(?!")[a-zA-Z_]\w*'),
    ("code-injection", "high", "Kotlin SQL injection via string template", r"""["']SELECT\b[^"']*\$(?:\{|\w)"""),
    ("code-injection", "high", "Kotlin SQL injection via string template", r"""["'](?:INSERT|UPDATE|DELETE)\b[^"']*\$(?:\{|\w)"""),
    ("shell-injection", "high", "Kotlin/Java command injection via Runtime.exec", r"Runtime\.getRuntime\(\)\.exec\s*\("),
    ("code-injection", "medium", "Spring Security CSRF protection disabled", r"\.csrf\(\)\s*\.?\s*disable\(\)"),
    ("code-injection", "high", "Spring Security permitAll on sensitive path", r"(?i)\.permitAll\(\).*(?:admin|manage|delete|config|setting)"),
    ("code-injection", "high", "PHP SQL injection via $wpdb->query with string concatenation", r"""\$wpdb\s*->\s*query\s*\(\s*["'][^"']*\$|.*\$wpdb\s*->\s*query\s*\(\s*[^"']*\.\s*\$"""),
    ("code-injection", "high", "PHP eval() with variable input", r"\beval\s*\(\s*\$"),
    ("shell-injection", "high", "PHP command injection via system/exec/shell_exec/passthru", r"\b(?:system|exec|shell_exec|passthru)\s*\(\s*\$"),
    ("code-injection", "high", "PHP preg_replace with /e modifier (code execution)", r"""preg_replace\s*\(\s*['"]/[^'"]*/e['"]"""),
    ("code-injection", "high", "PHP insecure deserialization of user input", r"\bunserialize\s*\(\s*\$(?:_GET|_POST|_REQUEST|_COOKIE)"),
    ("code-injection", "high", "PHP extract() on superglobal input", r"\bextract\s*\(\s*\$(?:_GET|_POST|_REQUEST)"),
)
PATHS = (
    ("Potential path traversal via path.join", r"path\.join\s*\(\s*(?:__dirname|root|base|projectRoot)[^)]*,"),
    ("readFileSync with potentially user-controlled path", r"(?i)readFileSync\s*\([^)]*(?:input|user|path|dir|file|query|params|body|req\.)"),
    ("writeFileSync with potentially user-controlled path", r"(?i)writeFileSync\s*\([^)]*(?:input|user|path|dir|file|query|params|body|req\.)"),
    ("createReadStream with potentially user-controlled path", r"(?i)createReadStream\s*\([^)]*(?:input|user|path|dir|file|query|params|body|req\.)"),
)
AUTH = (
    Rule("auth", "auth", "medium", "Fail-open catch block may bypass authentication", r"catch\s*\([^)]*\)\s*\{", frames=(Frame(0, 4, (r"(?:next\s*\(|return\s+true|resolve\s*\(\s*true\s*\))",), needed=True),)),
    Rule("auth", "auth", "high", "Credential in URL query parameter", r"[?&](?:token|session|key|auth)="),
    Rule("auth", "auth", "high", "Math.random() used in auth-related file", r"Math\.random\(\)", files=AUTH_FILES),
    Rule("auth", "auth", "medium", "JWT verification without expiry check", r"jwt\.verify\s*\(", frames=(Frame(5, 10, (r"(?:expiresIn|exp\s*:|maxAge)",)),)),
    Rule("auth", "auth", "low", "OAuth state cookie not cleared after use", r"(?i)state.*cookie", frames=(Frame(0, 9, (r"(?i)(?:maxAge.*0|clearCookie|delete.*state)",)),)),
)
INPUT = (
    Rule("input", "input-validation", "medium", "CORS wildcard origin", r"""cors\s*\(\s*\{\s*origin\s*:\s*['"]\*['"]|Access-Control-Allow-Origin.*\*"""),
    Rule("input", "input-validation", "medium", "No body size limit on JSON parser", r"express\.json\s*\(\s*\)", never=("limit",)),
    Rule("input", "input-validation", "medium", "req.params.id used without validation", r"req\.params\.id", frames=(Frame(3, 3, (r"(?:isValidUUID|uuid|^[0-9a-f-]{36}|validate|isValid|parseInt)",)),)),
    Rule("input", "input-validation", "low", "User input stored without length validation", r"(?:INSERT|db\.put|db\.create|\.save\(|\.insert\()", also=(r"req\.body",), frames=(Frame(5, 2, (r"\.length",)),)),
)
DISCLOSURE = (
    Rule("disclosure", "information-disclosure", "medium", "Stack trace in API response", r"res\.(?:json|send)\s*\(\s*\{[^}]*err\.stack|res\.(?:json|send)\s*\(\s*\{[^}]*stack\s*:"),
    Rule("disclosure", "information-disclosure", "low", "Environment variable enumeration", r"console\.(?:log|error|warn)\s*\(\s*process\.env\s*\)|Object\.keys\s*\(\s*process\.env\s*\)"),
    Rule("disclosure", "information-disclosure", "medium", "Potential credential in error/log message", r"(?i)`[^`]*(?:clone|fetch|pull|push)[^`]*\$\{.*(?:url|token|key|auth).*\}`"),
    Rule("disclosure", "information-disclosure", "low", "Debug log may contain sensitive value", r"(?i)console\.(?:log|debug|info)\s*\(.*(?:token|password|secret|key|auth|credential)", never=(r"""['"].*(?:token|password|secret|key|auth).*['"]""",)),
)
CRYPTO = (
    Rule("crypto", "cryptography", "medium", "Weak hash algorithm: MD5", r"""createHash\s*\(\s*['"]md5['"]\s*\)|hashlib\.md5\s*\(|MessageDigest\.getInstance\s*\(\s*["']MD5["']\s*\)""", worse="crypto"),
    Rule("crypto", "cryptography", "medium", "Weak hash algorithm: SHA-1", r"""createHash\s*\(\s*['"]sha1['"]\s*\)|hashlib\.sha1\s*\(|MessageDigest\.getInstance\s*\(\s*["']SHA-?1["']\s*\)""", worse="crypto"),
    Rule("crypto", "cryptography", "high", "Weak cipher algorithm: DES", r"""Cipher\.getInstance\s*\(\s*["']DES"""),
    Rule("crypto", "cryptography", "medium", "Potential log injection", r"(?:log|logger|LOG)\s*\.\s*(?:info|debug|warn|error|trace)\s*\([^)]*\+", also=(LOG_INPUT,)),
    Rule("crypto", "cryptography", "high", "Math.random() in cryptography-related file", r"Math\.random\(\)", files=CRYPTO_FILES),
    Rule("crypto", "cryptography", "medium", "HTTP used instead of HTTPS", r"""(?i)(?:fetch|axios\.(?:get|post|put|delete|patch)|http\.request)\s*\(\s*['"]http://(?!(?:localhost|127\.))"""),
    Rule("crypto", "cryptography", "high", "Hardcoded salt in key derivation", "pbkdf2", also=(r"""['"][a-zA-Z0-9+/=]{8,}['"]""",)),
    Rule("crypto", "cryptography", "medium", "Weak random: rand() in security context", r"\brand\s*\(\s*\)", files=CRYPTO_FILES),
    Rule("crypto", "cryptography", "high", "Hardcoded credentials in C++ source", r"""(?i)(?:const\s+(?:char|std::string)\s*\*?\s*(?:password|secret|api_key|apiKey|token)\s*=\s*["'])"""),
    Rule("crypto", "cryptography", "high", "Hardcoded credentials in Kotlin source", r"""(?i)(?:val|var)\s+(?:password|secret|apiKey|api_key|token)\s*=\s*["']"""),
    Rule("crypto", "cryptography", "medium", "Insecure random in Kotlin security context", r"\bRandom\s*\(\s*\)", files=CRYPTO_FILES),
    Rule("crypto", "cryptography", "medium", "Not-null assertion (!!) in security-sensitive Kotlin code", r"!!\s*\.", files=CRYPTO_FILES),
    Rule("crypto", "cryptography", "medium", "Hardcoded HTTP URL in Kotlin source", r"""(?:val|var)\s+\w*[Uu]rl\w*\s*=\s*["']http://(?!(?:localhost|127\.))"""),
    Rule("crypto", "cryptography", "high", "PHP md5() used for password hashing", r"\bmd5\s*\(", also=(PHP_PASSWORD,)),
    Rule("crypto", "cryptography", "high", "PHP sha1() used for password hashing", r"\bsha1\s*\(", also=(PHP_PASSWORD,)),
    Rule("crypto", "cryptography", "medium", "PHP crypt() with potentially weak salt", r"""\bcrypt\s*\(\s*[^,]+,\s*['"][$]?[12a-zA-Z]{0,3}['"]"""),
    Rule("crypto", "cryptography", "high", "PHP deprecated mcrypt_* function", r"\bmcrypt_"),
    Rule("crypto", "cryptography", "medium", "PHP rand()/mt_rand() in security context", r"\b(?:rand|mt_rand)\s*\(", files=CRYPTO_FILES),
    Rule("crypto", "cryptography", "high", "Hardcoded credentials in PHP source", r"""(?i)\$(?:password|secret|api_?key|token)\s*=\s*['"][^'"]{4,}['"]"""),
)
FRONTEND = (
    Rule("frontend", "frontend-xss", "high", "dangerouslySetInnerHTML usage", "dangerouslySetInnerHTML", files=FRONTEND_FILES),
    Rule("frontend", "frontend-xss", "high", "innerHTML assignment", r"\.innerHTML\s*=", files=FRONTEND_FILES),
    Rule("frontend", "frontend-xss", "medium", "document.write() usage", r"document\.write\s*\(", files=FRONTEND_FILES),
    Rule("frontend", "frontend-xss", "low", 'Missing rel="noopener" on target="_blank"', r"""target\s*=\s*["']_blank["']""", never=(r"""rel\s*=\s*["'][^"']*noopener[^"']*["']""",), files=FRONTEND_FILES),
    Rule("frontend", "frontend-xss", "high", "Sensitive data stored in browser storage", r"(?i)(?:localStorage|sessionStorage)\.setItem\s*\([^)]*(?:token|password|secret|key|auth)", files=FRONTEND_FILES),
)
# end of the fixed values

#: A resolved path that is held against a prefix nearby, and a literal file name just before, are taken as safe.
_CONTAINED, _LITERAL = Frame(15, 3, ("startsWith", "resolve")), Frame(2, 0, (FIXED_OUTPUT,))

#: Own rules for credentials in code, as the tool's list of them isn't published.
SECRETS = (
    Rule("secrets", "hardcoded-secret", "high", "literal credential", r"(?i)\b(api_?key|secret|password|passwd|token)\b\s*[:=]\s*['\"][^'\"\s]{8,}['\"]"),
    Rule("secrets", "hardcoded-secret", "critical", "private key", r"-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    Rule("secrets", "hardcoded-secret", "critical", "access key", r"\bAKIA[0-9A-Z]{16}\b"),
)

RULES = (
    *(Rule("injection", kind, severity, title, pattern, worse="input") for kind, severity, title, pattern in INJECTION),
    *(
        Rule("path-traversal", "path-traversal", "medium", title, pattern, also=(PATH_INPUT,), frames=(_CONTAINED, *([_LITERAL] if "FileSync" in title else [])), worse="route")
        for title, pattern in PATHS
    ),
    *AUTH, *INPUT, *DISCLOSURE, *CRYPTO, *FRONTEND, *SECRETS,
)

"""Fixed values of the rules over files, manifests and the corpus: names and patterns that must be exactly these for right results."""

WORKFLOW_DIR = ".github/workflows/"
WORKFLOW_NAME = r"\.y.*ml$"
USES = r"^\s*uses\s*:\s*([^\s#]+)"
QUOTES = "^[\"']+|[\"']+$"
OWNER = "^([^@/]*)"
OWN_OWNERS = ("actions", "github")
LOCAL_TARGETS = ("./", "docker://")
SECRETS = r"\$\{\{\s*secrets\.[A-Za-z0-9_]+\s*\}\}"
PULL_REQUEST_HEAD = r"\$\{\{\s*github\.event\.pull_request\.(?:head\.sha|head\.ref)\s*\}\}"
PULL_REQUEST_TARGET = r"^\s*pull_request_target\s*:\s*$"
CHECKOUT = r"^\s*uses\s*:\s*actions/checkout@"
COMMENT_TRIGGERS = ("issue_comment:", "pull_request_review_comment:", "repository_dispatch:")
COMMENT_GUARD = r"(?i)contains\(\s*github\.event\.comment\.body\s*,\s*['\"]/(?:run|test|deploy)"
UPLOAD = r"(?i)^\s*uses\s*:\s*actions/upload-artifact@"
DOWNLOAD = r"(?i)^\s*uses\s*:\s*actions/download-artifact@"
RETENTION = r"(?i)^\s*retention-days\s*:\s*(\d+)\s*$"
ARTIFACT_CHECK = r"(?i)\b(?:sha256sum|shasum\s+-a\s+256|gpg\s+--verify|cosign\s+verify|slsa-verifier)\b"

HEADER_NAMES = ("dockerfile", "nginx.conf", "caddyfile")
HEADER_SUFFIXES = (".conf", ".ini", ".cfg", ".env", ".yaml", ".yml", ".json", ".toml", ".py", ".js", ".ts")
HEADER_PATHS = (r"(?i)(?:nginx|apache|httpd|traefik|caddy)", r"(?i)(?:settings|config|security|headers?)")
HEADERS = (r"(?i)content-security-policy|\bcsp\b", r"(?i)strict-transport-security|\bhsts\b|includeSubDomains", r"(?i)x-content-type-options|nosniff", r"(?i)x-frame-options|frame-ancestors|deny|sameorigin", r"(?i)referrer-policy")

KEY_SUFFIXES = (".pem", ".key", ".p12", ".pfx", ".jks", ".kdb")
KEY_NAMES = ("id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", "private_key", "secret", "credentials", "token")
SESSION_SUFFIXES = (".env", ".ini", ".cfg", ".conf", ".yaml", ".yml", ".json", ".toml", ".py", ".js", ".ts")
SESSION = r"(?i)(?:session|cookie|session_cookie|sessionid|session_id)"
SESSION_RENEWED = r"(?i)(?:session[_-]?id\s*[:=]|set[_-]?cookie\([^\)]*session|regenerate|rotate|renew)"
PRIVATE_KEY_SUFFIXES = (".pem", ".key", ".txt", ".env", ".cfg", ".conf", ".ini", ".yaml", ".yml", ".json", ".toml", ".md", ".py", ".js", ".ts", ".sh")
PRIVATE_KEY = r"-----BEGIN\s+(?:RSA\s+|EC\s+|DSA\s+|OPENSSH\s+)?PRIVATE\s+KEY-----"
ROOT_USER, ANY_USER = r"(?i)^\s*USER\s+(?:root|0)(?:\b|:)", r"(?i)^\s*USER\s+"
ROOT_SUFFIXES = (".yml", ".yaml", ".json", ".env", ".conf", ".ini", ".txt", ".md")
ROOT_LINES = (r"(?i)^\s*user\s*:\s*[\"']?(?:root|0(?::0)?)\b", r"(?i)^\s*runAsUser\s*:\s*0\b")
SANDBOX = r"(?i)\b(?:sandbox|seccomp|gvisor|firejail|isolate|nsjail|chroot|runsc|wasm|vm2|jail)\b"
EXECUTION = (r"(?i)\b(?:eval|exec)\s*\(", r"(?i)\bos\.system\s*\(", r"(?i)\bsubprocess\.(?:run|Popen|call|check_output)\s*\(", r"(?i)\bvm\.runIn(?:NewContext|Context)\s*\(")
UNTRUSTED = r"(?i)\b(?:user(?:_provided)?|untrusted|plugin|script|request\.|req\.|query|params|body|payload)\b"
TLS_SUFFIXES = (".md", ".rst", ".txt", ".adoc", ".yml", ".yaml")
TLS_PATHS = (r"(?i)(?:^|[\\/])(?:README|SECURITY|TLS|SSL|CERTIFICATE|CERTS)(?:\.[^\\/]*)?$", r"(?i)(?:^|[\\/])docs?[\\/].*(?:tls|ssl|cert)")
TLS_EXPIRED = r"(?i)\b(?:expired|期限切れ|失効|not\s+valid\s+after|certificate\s+expired)\b"
TLS_WORDS = r"(?i)\b(?:tls|ssl|certificate|cert|renew|rotation|acme|letsencrypt)\b"

POLICIES = ("SECURITY.md", "SECURITY.txt", "SECURITY.rst", ".github/SECURITY.md", "docs/SECURITY.md")
READMES = ("README.md", "README.rst", "README.txt")
POLICY_HINT = r"(?is)(security|vulnerability|脆弱性).{0,120}(report|contact|連絡|報告|disclosure)"
TEMPLATE_DIRS = (".github/ISSUE_TEMPLATE/", "docs/ISSUE_TEMPLATE/")
TEMPLATE_NAME = r"\.(?:md|yml)$"
TEMPLATES = (".github/ISSUE_TEMPLATE.md", ".gitlab/issue_templates/bug.md")
CHANGE_LOGS = ("CHANGELOG.md", "CHANGELOG.rst", "CHANGELOG.txt", "HISTORY.md")
BILLS = ("sbom.json", "sbom.xml", "bom.json", "bom.xml", "cyclonedx.json", "cyclonedx.xml", "spdx.json", "spdx.yaml", "spdx.yml", "spdx.spdx")
BILL_DIRS, BILL_WORDS, BILL_SUFFIXES = ("sbom/", "sboms/", ".github/", "docs/"), ("sbom", "cyclonedx", "spdx"), (".json", ".xml", ".yml", ".yaml", ".spdx")

PYTHON_MANIFESTS, PYTHON_LOCKS = ("requirements.txt", "pyproject.toml"), ("poetry.lock", "Pipfile.lock", "uv.lock")
NODE_MANIFESTS, NODE_LOCKS = ("package.json",), ("package-lock.json", "yarn.lock", "pnpm-lock.yaml")
LOOSE_MARKS = ("*", "latest", "^", "~", ">", "<", "x", "||", " - ")
PLAIN_VERSION = r"^\d+\.\d+\.\d+$"
SUSPICIOUS_PARTS, SUSPICIOUS_SPECS = ("..", "__", "tmp", "test", "malware"), ("git+http://", "http://", "https://", "file:")
COMMON_PACKAGES = ("requests", "numpy", "pandas", "flask", "django", "pyyaml", "urllib3", "react", "express", "lodash", "axios", "typescript")
#: package, first version that is not deprecated
DEPRECATED_BELOW = (("django", (3, 2)), ("flask", (2, 0)), ("urllib3", (2, 0)), ("setuptools", (45, 0)), ("react", (17, 0, 0)))
DEPRECATED = ("easy_install", "left-pad")
VERSION = r"(\d+(?:\.\d+)*)"
#: package name, import name
IMPORT_NAMES = (("pyyaml", "yaml"), ("pillow", "pil"), ("python-dotenv", "dotenv"), ("beautifulsoup4", "bs4"), ("scikit-learn", "sklearn"))

STRONG_COPYLEFT = ("GPL-2.0", "GPL-2.0-ONLY", "GPL-2.0-OR-LATER", "GPL-3.0", "GPL-3.0-ONLY", "GPL-3.0-OR-LATER", "AGPL-3.0", "AGPL-3.0-ONLY", "AGPL-3.0-OR-LATER")
LICENSE_FILES = ("LICENSE", "LICENSE.txt", "LICENSE.md", "COPYING", "COPYING.txt", "COPYING.md", "UNLICENSE")
NONCOMMERCIAL = ("noncommercial", "non-commercial", "for non commercial use", "not for commercial use", "for personal use only", "cc-by-nc", "cc by-nc")
LICENSE_TOKEN = r"[A-Za-z][A-Za-z0-9.+-]*"
VAGUE_LICENSES = ("unknown", "unlicensed", "see license in", "no license", "none")
UNKNOWN_LICENSES = ("", "unknown", "unlicensed", "none", "see license in", "n/a")
CLOSED_FILES = ("EULA", "EULA.txt", "NOTICE", "NOTICE.txt")
CLOSED_TERMS = ("all rights reserved", "proprietary", "closed source", "commercial license")

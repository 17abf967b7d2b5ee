"""Fixed values of rules A-1 to A-8: names and patterns that must be exactly these for right results."""

SOURCE_CALLS = {"input", "os.getenv", "os.environ.get", "environ.get"}
SOURCE_TABLES = {"sys.argv", "os.environ", "environ"}
SQL_CALLS = {"execute", "executemany", "raw", "raw_query"}
SQL_PARAMETERS = r"%s|\?|:\w+"
DESERIALIZERS = {"pickle.loads", "pickle.load", "dill.loads", "dill.load", "marshal.loads", "jsonpickle.decode", "yaml.load"}
SAFE_LOADER = "SafeLoader"
FILE_CALLS = {"open", "os.open", "os.remove", "os.unlink", "os.rmdir", "shutil.rmtree", "Path", "pathlib.Path"}
PATH_JOINS = {"os.path.join", "pathlib.Path.joinpath"}
REQUEST_CALLS = {
    "requests.get", "requests.post", "requests.put", "requests.patch", "requests.delete", "requests.request",
    "httpx.get", "httpx.post", "httpx.put", "httpx.patch", "httpx.delete", "httpx.request",
    "urllib.request.urlopen", "urllib3.PoolManager.request",
}
MARKUP_CALLS = {"flask.render_template_string", "render_template_string", "jinja2.Template", "markupsafe.Markup", "Markup"}
TEMPLATE_CALLS = {
    "jinja2.Template", "Template", "jinja2.Environment.from_string", "Environment.from_string",
    "flask.render_template_string", "render_template_string", "mako.template.Template", "django.template.Template",
}
EVAL_CALLS = {"eval", "exec", "builtins.eval", "builtins.exec"}
LITERAL_EVAL_CALLS = {"ast.literal_eval"}

SHELL_CALLS = {"os.system", "os.popen", "asyncio.create_subprocess_shell", "subprocess.getoutput", "subprocess.getstatusoutput", "platform.popen"}
EXEC_CALLS = {
    "os.spawnl", "os.spawnlp", "os.spawnv", "os.spawnvp", "os.execl", "os.execle", "os.execlp", "os.execlpe",
    "os.execv", "os.execve", "os.execvp", "os.execvpe", "pty.spawn",
}
PROCESS_CALLS = {"subprocess.run", "subprocess.Popen", "subprocess.call", "subprocess.check_call", "subprocess.check_output"}
COMMAND_KEYWORDS = ("args", "cmd", "command")
URL_KEYWORDS = ("url", "uri")
EXIT_CALLS = ("exit", "quit", "sys.exit")
#: A pattern that re.fullmatch may be given for its argument to count as checked; ".*" may not be part of it.
CHECKED_PATTERN = r"\^[\^$\[\]A-Za-z0-9_.\\+*?{}|()\-]*\$"
REQUEST_OBJECT = r"(?:flask\.)?request(?:\.|$)"

JS_SUFFIXES = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs")
JS_SOURCES = ("req.query", "req.body", "req.params", "req.headers", "request.query", "request.body", "request.params", "request.headers", "ctx.query", "ctx.request.body", "process.argv", "process.env")
JS_SANITIZERS = ("shellEscape", "escapeShellArg", "shellQuote.quote", "quote")
JS_CHILD_CALLS = ("execFileSync", "execFile", "execSync", "exec", "spawnSync", "spawn", "fork")
JS_IMPORT = r"import\s*\{([^}]+)\}\s*from\s*['\"](?:node:)?child_process['\"]"
JS_REQUIRE_PARTS = r"(?:const|let|var)\s*\{([^}]+)\}\s*=\s*require\(['\"](?:node:)?child_process['\"]\)"
JS_REQUIRE = r"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*require\(['\"](?:node:)?child_process['\"]\)"
JS_BINDING = r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(.+)$"
JS_RENAMED_IMPORT = r"(?:execFileSync|execFile|execSync|exec|spawnSync|spawn|fork)\s+as\s+([A-Za-z_$][\w$]*)"
JS_RENAMED_PART = r"(?:execFileSync|execFile|execSync|exec|spawnSync|spawn|fork)\s*:\s*([A-Za-z_$][\w$]*)"
JS_SHELL_OPTION = r"\{[^}]*\bshell\s*:\s*true\b[^}]*\}"
JS_NAME = r"[A-Za-z_$][\w$]*"
JS_SHELL_TRUE = ("shell: true", "shell:true")
JS_FILE_CALL = r"\b(?:execFile|execFileSync|fork)\s*\("
JS_HELPER_CALL = r"\b(?:shelljs\.)?exec\s*\(|\bexeca\.command(?:Sync)?\s*\("

SHELL_SUFFIXES = (".sh", ".bash", ".zsh", ".ksh")
SHELL_ARGUMENT = r"\$[0-9@*]|\$\{[0-9]+\}"
SHELL_READ = r"\bread\b(?:\s+-\w+)*\s+([A-Za-z_][A-Za-z0-9_]*)"
SHELL_SET = r"^([A-Za-z_][A-Za-z0-9_]*)=(.+)$"
SHELL_CASE = r"\bcase\s+\"?\$\{?([A-Za-z_][A-Za-z0-9_]*)\}?\"?\s+in\b.*\*\)\s*(?:exit|return)\b.*\besac\b"
#: (pattern, what, whether the line is done with it), in order
SHELL_CHECKS = (
    (r"\beval\b", "eval", True),
    (r"\b(?:sh|bash|zsh|ksh)\s+-c\b", "sh -c", True),
    (r"`[^`]*\$[^`]*`", "a backtick command", False),
    (r"\$\([^)]*\$[^)]*\)", "a command substitution", True),
    (r"\b(?:source|\.)\s+[^#;]*\$", "a sourced path", True),
)
#: NAME stands for a variable's name.
SHELL_LEAD = r"^(?:command\s+|env\s+)?\"?\$\{?NAME\}?\"?(?:\s|$)"
SHELL_HERE_STRING = r"\b(?:sh|bash|zsh|ksh)\s+<<<\s*"

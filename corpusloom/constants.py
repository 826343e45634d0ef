"""Fixed values.

Everything in this file is data that results depend on: lookup tables, word
lists, limits and formats. The values are stated as they are, in their natural
order; no logic lives here.
"""

# --- Fixed values: extension (or exact base name) to language -----------------
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".html": "html", ".htm": "html",
    ".css": "css", ".scss": "scss", ".sass": "sass", ".less": "less",
    ".vue": "vue", ".svelte": "svelte",
    ".py": "python", ".pyw": "python",
    ".go": "go", ".java": "java",
    ".kt": "kotlin", ".kts": "kotlin",
    ".scala": "scala", ".rs": "rust", ".rb": "ruby", ".php": "php",
    ".cs": "csharp", ".fs": "fsharp", ".swift": "swift",
    ".m": "objectivec", ".mm": "objectivec",
    ".c": "c", ".h": "c",
    ".cpp": "cpp", ".hpp": "cpp", ".cxx": "cpp", ".hxx": "cpp", ".cc": "cpp", ".hh": "cpp",
    ".pl": "perl", ".pm": "perl", ".lua": "lua",
    ".sh": "shell", ".bash": "shell", ".zsh": "shell", ".ps1": "powershell",
    ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".xml": "xml",
    ".sql": "sql", ".csv": "csv", ".md": "markdown", ".rst": "rst",
    ".tf": "terraform", ".tfvars": "terraform", ".hcl": "hcl",
    ".dockerfile": "dockerfile", "Dockerfile": "dockerfile",
    ".r": "r",
}

# --- Fixed values: language to (formatter, linter) -----------------------------
TOOLS = {
    "javascript": ("prettier", "eslint"),
    "typescript": ("prettier", "eslint"),
    "jsx": ("prettier", "eslint"),
    "tsx": ("prettier", "eslint"),
    "go": ("gofmt", None),
    "python": ("black", "isort"),
}

# --- Fixed values: text checks --------------------------------------------------
TEXT_PREFIX_V1 = 1024
TEXT_PREFIX_V2 = 4096
MAX_CONTROL_RATIO = 0.3
MAX_NUL_BYTES = 2

# First three bytes, in hex, of contents that count as binary (check v1).
BINARY_SIGNATURES = [
    "000000", "FFD8FF", "89504E", "474946", "49492A", "4D4D00", "255044", "504B03",
    "1F8B08", "377ABC", "526172", "4D5A90", "7F454C", "CAFEBA", "FEEDFA", "0000FE",
]

# Extensions that count as binary without reading the content (check v2).
BINARY_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff", ".ico",
    ".pdf",
    ".mp3", ".wav", ".ogg", ".flac",
    ".mp4", ".avi", ".mov", ".mkv",
    ".zip", ".gz", ".tar", ".rar", ".7z",
    ".exe", ".dll", ".so", ".dylib", ".app",
    ".o", ".a", ".obj",
    ".class", ".jar",
    ".pyc", ".pyo",
    ".sqlite", ".db",
    ".woff", ".woff2", ".ttf", ".otf", ".eot",
    ".DS_Store",
]

# --- Fixed values: default rules for a repository without an ignore file (v1) ---
DEFAULT_RULES_V1 = [
    ".git/", ".git/**", "node_modules/", "vendor/", "dist/", "build/",
    "*.log", "*.lock", "*.exe", "*.dll", "*.so", "*.dylib", "*.class", "*.jar", "*.war",
    "*.ear", "*.zip", "*.tar", "*.gz", "*.rar", "*.7z", "*.pdf", "*.jpg", "*.jpeg", "*.png",
    "*.gif", "*.ico", "*.svg", "*.woff", "*.woff2", "*.ttf", "*.eot", "*.mp4", "*.webm",
    "*.mp3", "*.wav", "*.flac", "*.m4a", "*.db", "*.sqlite", "*.sqlite3", "*.cache", "*.tmp",
    "*.temp", "*.bak", "*.swp", "*.swo", "*~", ".DS_Store", "Thumbs.db",
    "*.bin", "*.dat", "*.iso", "*.img",
    ".idea/", ".vscode/", ".vs/", "*.sublime-*",
    "*.o", "*.obj", "*.a", "*.lib", "*.pyc", "*.pyo", "__pycache__/", ".pytest_cache/",
    "bower_components/", "jspm_packages/", ".pnpm-store/",
    "coverage/", ".nyc_output/", "test-results/", "cypress/videos/", "cypress/screenshots/",
    "tmp/", "temp/", "logs/",
    ".env", ".env.local", ".env.*.local",
    "docs/_build/", "_site/", ".docusaurus/", ".vuepress/dist/",
    "llm.txt",
]

# --- Fixed values: default rules (v2) --------------------------------------------
DEFAULT_RULES_V2 = [
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock", "Cargo.lock",
    "Gemfile.lock", "go.sum",
    "dist/", "build/", "coverage/", "*.min.js", "*.min.css",
    "*.csv", "*.xlsx", "*.parquet", "*.sql", "*.db", "*.sqlite",
    "*.jpg", "*.jpeg", "*.png", "*.gif", "*.ico", "*.svg", "*.webp",
    "**/*.map", "**/__pycache__/", "**/.pytest_cache/", "**/.next/", "**/.nuxt/",
    ".DS_Store", "Thumbs.db", ".env.local", ".idea/", ".vscode/", "*.swp", "*.swo",
    ".turbo/", ".cache/", ".parcel-cache/", ".rollup.cache/", ".webpack/", ".eslintcache",
    ".stylelintcache", ".tsbuildinfo",
    "node_modules/", "bower_components/", "jspm_packages/", ".pnpm-store/",
    "coverage/", ".nyc_output/", "test-results/", "cypress/videos/", "cypress/screenshots/",
    "reports/",
    "*.log", "*.tmp", "*.temp", "tmp/", "temp/", "logs/",
    ".history/", ".settings/", "*.sublime-workspace", "*.sublime-project", ".project",
    ".classpath", "*.iml", ".factorypath",
    ".gradle/", "target/", "out/", "bin/", "obj/",
    "docs/_build/", "_site/", ".docusaurus/", ".vuepress/dist/",
    ".vercel/", ".netlify/", "storybook-static/", "public/sitemap*.xml", "public/robots.txt",
    "public/feed.xml", ".next/", "llm.txt",
]

# Always appended after the ignore files (v2).
ALWAYS_RULES_V2 = [
    ".git/", "__pycache__/", "node_modules/", "vendor/", "build/", "dist/", "target/",
    "*.pyc", "*.pyo", "*.class", "*.log", "*.swp", ".DS_Store", "Thumbs.db",
]

# Always appended after the command-line rules (v1).
ALWAYS_RULES_V1 = [".git/", ".git/**", "node_modules/", "node_modules/**"]

GITIGNORE_FILE = ".gitignore"
PACKIGNORE_FILE = ".llmignore"
DEFAULT_OUTPUT_FILE = "llm.txt"

# --- Fixed values: directories skipped by name -----------------------------------
ROOT_SKIPPED_DIRS = [".git", "node_modules"]
WALK_SKIPPED_DIRS = ["node_modules", "vendor", ".git"]
WALK_KEPT_DOT_DIRS = [".github", ".vscode"]

# --- Fixed values: documentation files -------------------------------------------
DOC_DIRS = ["docs", "doc", "documentation", "."]
DOC_SUFFIXES = [".md", ".rst", ".txt", ".adoc", ".asciidoc"]

# --- Fixed values: fences around model replies ------------------------------------
FENCE = "```"
EDITOR_FENCES = ["```typescript", "```tsx", "```js", "```javascript", "```ts", "```"]
GENERAL_FENCES = [
    "```typescript", "```tsx", "```javascript", "```js", "```python", "```py", "```go",
    "```golang", "```rust", "```rs", "```java", "```kotlin", "```scala", "```csharp", "```cs",
    "```c", "```cpp", "```objectivec", "```php", "```ruby", "```rb", "```swift", "```bash",
    "```sh", "```zsh", "```yaml", "```yml", "```json", "```html", "```xml", "```css", "```scss",
    "```less", "```markdown", "```md", "```sql", "```text", "```",
]

# --- Fixed values: replies and outcomes -------------------------------------------
NO_UPDATE = "NO_UPDATE_NEEDED"
NO_CHANGES_PHRASE = "no changes needed"
MIN_PROPOSAL_BYTES = 10

# --- Fixed values: budgeted context ------------------------------------------------
CONTEXT_BUDGET = 100_000
TRUNCATION_RESERVE = 20
TRUNCATION_LINE = "\n... (file truncated)\n"

# --- Fixed values: chat requests ----------------------------------------------------
DEFAULT_MODEL = "gpt-4o"
EMPTY_MODEL = "gpt-3.5-turbo"
SYSTEM_MESSAGE = (
    "You are a helpful assistant specialized in refactoring code. "
    "Provide complete refactored code without explanations."
)
TEMPERATURE = 0.2
MAX_TOKENS = 4096
TOP_P = 0.95
FREQUENCY_PENALTY = 0.0
PRESENCE_PENALTY = 0.0
GENERATE_TRIES = 3
GENERATE_WAITS = (2.0, 4.0)
GENERATE_TIMEOUT = 180.0

# --- Fixed values: pack layout --------------------------------------------------------
RULE_LINE = "============================================================\n"

# --- Fixed values: white space cut off by trimming -------------------------------------
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Word inside the edit-block marker lines. Replies that use another word are read
# by passing it as ``marker``.
MARKER = "EDIT"

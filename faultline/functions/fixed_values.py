"""Rule rows, word lists and names that results depend on. They are data, not logic."""

from __future__ import annotations

# Signal, name, category, description, weight, path markers, extensions, file names, recommendation,
# recommendation type, threshold
RULES = [
    ("authentication_change", "Authentication Modified", "security", "Authentication, login, logout, or user identity verification logic was modified.", 0.22, ["auth/", "authentication/", "login/", "logout/", "login", "logout", "authmanager", "authenticator", "biometric", "mfa", "2fa"], [], [], "Run authentication regression tests and request security review before merging.", "POLICY_BASED", "1 file"),
    ("authorization_change", "Authorization Modified", "security", "Role-based access control, user roles, or permission enforcement policies changed.", 0.2, ["permission/", "rbac/", "acl/", "policy/", "permissionmanager", "authorizer"], [], [], "Verify access control checks across all protected endpoints and user actions.", "POLICY_BASED", "1 file"),
    ("credential_change", "Credentials & Password Handling Modified", "security", "Password hashing, keystore, keychain, or credential storage modified.", 0.24, ["password", "keystore", "keychain", "credential", "credentialmanager"], [], [], "Verify credentials are encrypted at rest and never logged in cleartext.", "POLICY_BASED", "1 file"),
    ("session_change", "Session Management Modified", "security", "User session lifecycle, session tokens, or session timeout handling modified.", 0.2, ["session/", "sessionmanager", "session_manager", "usersession", "tokenmanager", "jwt"], [], [], "Verify session invalidation on logout and ensure token expiration is enforced.", "POLICY_BASED", "1 file"),
    ("crypto_change", "Cryptography / Encryption Modified", "security", "Cryptographic cipher, key generation, or hashing algorithms altered.", 0.24, ["crypto/", "cipher", "encryption", "aes", "rsa", "hash"], [], [], "Ensure industry-standard algorithms (AES-256, RSA-4096, SHA-256) are utilized.", "POLICY_BASED", "1 file"),
    ("permission_change", "System Permissions Modified", "security", "Application system permissions or runtime permission requests modified.", 0.18, [], [], ["androidmanifest.xml"], "Review requested permissions for principle of least privilege.", "POLICY_BASED", "1 file"),
    ("secrets_modified", "Secrets / Credentials Modified", "security", "Secrets, credential templates, or key stores were edited.", 0.25, ["secret", "private_key", "pem"], [], [".env", ".env.local", ".env.production", "secrets.yaml", "secrets.json", "secrets.xml"], "Audit secret storage for cleartext leaks and rotate compromised tokens.", "POLICY_BASED", "1 file"),
    ("database_schema_change", "Database Schema Changed", "database", "ORM models, SQL schemas, or database tables were altered.", 0.2, ["schema/", "models/", "entities/", "prisma/"], [".sql"], [], "Verify backward compatibility and check for destructive column drops.", "EVIDENCE_BACKED", "1 file"),
    ("migration_detected", "Migration Script Detected", "database", "Database migration scripts were added or modified.", 0.18, ["alembic/", "migration/", "migrations/"], [".sql"], [], "Test forward and backward migration scripts on staging before deployment.", "EVIDENCE_BACKED", "1 file"),
    ("no_rollback_plan", "No Rollback Plan / Destructive Schema", "database", "Destructive table or column changes detected without rollback safety.", 0.18, ["drop_column", "drop_table", "truncate"], [], [], "Ensure migration scripts include down_revision rollback steps.", "EVIDENCE_BACKED", "1 file"),
    ("api_contract_changed", "API Contract Modified", "api", "API route definitions, schemas, or OpenAPI specifications changed.", 0.16, ["api/", "routes/", "openapi", "graphql", "proto/"], [], [], "Ensure frontend client SDKs and public API consumers remain compatible.", "EVIDENCE_BACKED", "1 file"),
    ("deleted_public_api", "Deleted Public API Endpoint", "api", "Public API endpoints or handler routes were removed.", 0.22, ["router.delete", "delete_endpoint"], [], [], "Check API gateway routes and notify external API consumers.", "EVIDENCE_BACKED", "1 file"),
    ("dockerfile_modified", "Dockerfile / Container Build Changed", "infrastructure", "Container build steps or runtime base image changed.", 0.14, [], [], ["dockerfile", "docker-compose.yml", "docker-compose.yaml"], "Rebuild container image locally and verify container startup health.", "EVIDENCE_BACKED", "1 file"),
    ("github_actions_modified", "CI/CD Workflow Modified", "infrastructure", "GitHub Actions or CI pipeline workflow files modified.", 0.14, [".github/workflows/", "ci.yml", "pipeline.yml"], [], [], "Test pipeline execution on a pull request branch before merging.", "EVIDENCE_BACKED", "1 file"),
    ("terraform_changed", "Terraform IaC Changed", "infrastructure", "Infrastructure as Code Terraform manifests modified.", 0.18, [], [".tf"], [], "Execute `terraform plan` to verify cloud resource modifications.", "EVIDENCE_BACKED", "1 file"),
    ("kubernetes_manifests_changed", "Kubernetes Manifests Modified", "infrastructure", "K8s deployment, service, or ingress manifests modified.", 0.16, ["k8s/", "kubernetes/", "helm/", "deployment.yaml"], [], [], "Run `kubectl diff` against staging cluster before applying.", "EVIDENCE_BACKED", "1 file"),
    ("env_vars_changed", "Environment Configuration Modified", "infrastructure", "Environment variable configuration or settings files modified.", 0.12, [".env", "config.py", "settings.py", "env.example"], [], [], "Update environment configuration across deployment environments.", "POLICY_BASED", "1 file"),
    ("shared_library_modified", "Shared Library / Core Utility Modified", "architecture", "Shared core library or utility module modified.", 0.16, ["shared/", "common/", "core/", "utils/", "lib/"], [], [], "Run full repository unit test suite across all dependent modules.", "EVIDENCE_BACKED", "1 file"),
    ("dependency_upgrades", "Package Dependencies Upgraded", "architecture", "Package manager dependency files modified.", 0.14, [], [], ["package.json", "package-lock.json", "pyproject.toml", "requirements.txt", "build.gradle", "build.gradle.kts", "pom.xml"], "Audit updated dependencies for breaking changes and vulnerability advisories.", "POLICY_BASED", "1 file"),
    ("critical_component_modified", "Critical Business Component Modified", "architecture", "Core payment, billing, or critical domain component modified.", 0.2, ["payment/", "billing/", "order/", "checkout/"], [], [], "Run end-to-end integration tests for critical business workflows.", "POLICY_BASED", "1 file"),
    ("breaking_exported_interface", "Breaking Exported Interface Change", "architecture", "Exported class or function modified with downstream consumer usage.", 0.18, [], [], [], "Check call sites across all importing files for parameter mismatches.", "EVIDENCE_BACKED", "1 interface"),
    ("circular_dependency", "Circular Import Dependency", "architecture", "Modified files participate in a circular module import loop.", 0.18, [], [], [], "Refactor circular imports into a separate shared interface or utility.", "EVIDENCE_BACKED", "1 cycle"),
    ("high_fan_out_module", "High Fan-Out Module (Tight Coupling)", "architecture", "Changed file imports more than 10 downstream modules.", 0.14, [], [], [], "Apply dependency inversion to decouple high fan-out module.", "POLICY_BASED", "> 10 imports"),
]

# Fixed values
SOURCE_EXTENSIONS = [
    ".c", ".cc", ".cpp", ".cs", ".go", ".h", ".hpp", ".java", ".js", ".jsx", ".kt", ".kts", ".m", ".mm", ".php",
    ".py", ".rb", ".rs", ".scala", ".swift", ".ts", ".tsx",
]

# Fixed values
ASSET_EXTENSIONS = [
    ".aar", ".dll", ".eot", ".exe", ".gif", ".ico", ".jar", ".jpeg", ".jpg", ".mp3", ".mp4", ".ogg", ".otf", ".png",
    ".so", ".svg", ".ttf", ".wav", ".webp", ".woff", ".woff2",
]

# Fixed values
DOC_EXTENSIONS = [
    ".adoc", ".html", ".md", ".mdx", ".pdf", ".rst", ".txt",
]

# Fixed values
BACKUP_EXTENSIONS = [
    ".bak", ".orig", ".swo", ".swp", ".tmp", "~",
]

# Fixed values
BUILD_FILENAMES = [
    "build.gradle", "build.gradle.kts", "cargo.toml", "cmakelists.txt", "docker-compose.yaml", "docker-compose.yml",
    "dockerfile", "gemfile", "makefile", "pom.xml", "settings.gradle", "settings.gradle.kts",
]

# Fixed values
CONFIG_FILENAMES = [
    ".env", ".env.development", ".env.example", ".env.local", ".env.production", ".eslintrc.js", ".eslintrc.json",
    ".eslintrc.yml", ".prettierrc", "androidmanifest.xml", "babel.config.js", "eslint.config.js", "next.config.js",
    "next.config.mjs", "next.config.ts", "package-lock.json", "package.json", "pnpm-lock.yaml", "postcss.config.js",
    "postcss.config.mjs", "pyproject.toml", "requirements.txt", "rollup.config.js", "setup.cfg", "setup.py",
    "tailwind.config.js", "tailwind.config.ts", "tsconfig.base.json", "tsconfig.json", "tsconfig.node.json",
    "vite.config.js", "vite.config.mjs", "vite.config.ts", "webpack.config.js", "yarn.lock",
]

# Fixed values
SCRIPT_FILENAMES = [
    "build.js", "build.py", "deploy.js", "manage.py", "migrate.js", "release.js", "run.js", "run.py", "script.js",
    "script.py", "scripts.js", "scripts.py", "seed.js", "seed.py", "setup.js",
]

# Fixed values
FRAMEWORK_ENTRYPOINT_FILENAMES = [
    "__main__.py", "analysis_worker.py", "celery.py", "conftest.py", "database.py", "default.tsx", "env.py",
    "global-error.jsx", "global-error.tsx", "instrumentation.js", "instrumentation.ts", "manage.py",
    "middleware.js", "middleware.ts", "session.py", "tasks.py", "template.tsx", "worker.py",
]

# Fixed values
ENTRYPOINT_FILENAMES = [
    "App.kt", "Application.kt", "MainActivity.kt", "MainApplication.kt", "analysis_worker.py", "api-client.ts",
    "api_client.py", "app.js", "app.jsx", "app.py", "app.ts", "app.tsx", "cli.js", "cli.py", "cli.ts", "client.js",
    "client.py", "client.ts", "env.py", "index.js", "index.jsx", "index.py", "index.ts", "index.tsx", "main.js",
    "main.jsx", "main.py", "main.ts", "main.tsx", "middleware.js", "middleware.ts", "sdk.js", "sdk.py", "sdk.ts",
    "server.js", "server.jsx", "server.py", "server.ts", "server.tsx", "tasks.py", "worker.js", "worker.py",
    "worker.ts",
]

# Fixed values
IGNORED_PATTERNS = [
    "node_modules/", ".git/", ".next/", "dist/", "build/", "coverage/", "venv/", ".venv/", "__pycache__/",
    "target/", ".pytest_cache/", ".idea/", ".gradle/", "gradle/", ".settings/", ".vscode/",
]

# Fixed values
PARSER_CONFIG_FILENAMES = [
    "next.config.js", "next.config.mjs", "next.config.ts", "vite.config.js", "vite.config.ts", "vitest.config.js",
    "vitest.config.ts", "eslint.config.js", "eslint.config.mjs", "tsconfig.json", "package.json", "Dockerfile",
    "docker-compose.yml", "pyproject.toml", "setup.py", "build.gradle", "build.gradle.kts", "settings.gradle",
    "settings.gradle.kts", "pom.xml", "AndroidManifest.xml",
]
# Directories and names by role
IDE_DIRS = [".idea", ".vscode", ".settings", ".gradle"]
IDE_SUFFIXES = [".iml", ".ipr", ".iws"]
OUTPUT_DIRS = ["build", "dist", "out", "target", "generated", "__pycache__", ".next", "coverage"]
DOC_NAMES = ["license", "notice", "readme", "contributing"]
TEST_DIRS = ["test", "tests", "androidtest", "__tests__", "spec", "specs"]
TEST_ENDINGS = ["test.kt", "tests.kt", "spec.kt", "test.java", "spec.ts", "test.ts", "test.py", "_test.py"]
DATA_SUFFIXES = [".json", ".toml", ".yaml", ".yml", ".properties"]
RELEVANT_TYPES = ["SOURCE", "TEST", "BUILD", "CONFIGURATION"]

# roles
ROLE_GENERATED_DIRS = [
    "dist", "build", "out", "target", "generated", "__pycache__", ".next", "coverage", ".git", ".gradle", ".idea", ".vscode",
    "node_modules", "venv", ".venv", ".turbo", ".cache", "vendor", "third_party", "third-party",
]
ROLE_GENERATED_ENDINGS = [".min.js", ".min.css", ".bundle.js", ".d.ts.map", ".chunk.js", ".map", ".pyc", ".class"]
ROLE_DOC_DIRS = ["docs", "doc", "documentation", "guides", "guide", "manual", "specifications"]
ROLE_DOC_STEMS = ["readme", "license", "copying", "notice", "contributing", "changelog", "authors", "code_of_conduct", "security"]
ROLE_EXAMPLE_DIRS = ["examples", "samples", "sample", "demo", "demos", "quickstart", "tutorials", "showcase"]
ROLE_NAMESPACES = ["com", "org", "net", "io", "java", "kotlin", "src"]
ROLE_TEST_DIRS = ["test", "tests", "androidtest", "__tests__", "__test__", "spec", "specs", "testfixtures", "fixtures", "mocks", "stubs"]
ROLE_TEST_ENDINGS = [
    "test.kt", "tests.kt", "spec.kt", "test.java", "tests.java", "spec.ts", "spec.tsx", "test.ts", "test.tsx", "test.js",
    "test.jsx", "spec.js", "spec.jsx", "test.py", "_test.py", "_test.go", "_test.rs",
]
ROLE_SCRIPT_DIRS = ["scripts", "script", "bin", "tools", "ci/scripts", "dev/scripts"]
ROLE_SCRIPT_SUFFIXES = [".sh", ".bash", ".zsh", ".bat", ".cmd", ".ps1", ".fish"]
ROLE_CONFIG_SUFFIXES = [".json", ".toml", ".yaml", ".yml", ".xml", ".properties", ".ini", ".cfg", ".conf", ".gradle"]
ROLE_COMPONENT_STEMS = [
    "activity", "service", "receiver", "broadcastreceiver", "provider", "contentprovider", "application", "screen", "viewmodel",
]
ROLE_SIGNALS = ["Activity", "Service", "BroadcastReceiver", "ViewModel", "Jetpack Compose"]
ROLE_ROUTE_NAMES = [
    "page.tsx", "page.jsx", "page.ts", "page.js", "layout.tsx", "layout.jsx", "layout.ts", "layout.js", "route.ts", "route.js",
    "route.tsx", "route.jsx", "loading.tsx", "loading.jsx", "loading.ts", "loading.js", "error.tsx", "error.jsx", "error.ts",
    "error.js", "not-found.tsx", "not-found.jsx", "not-found.ts", "not-found.js", "global-error.tsx", "global-error.jsx",
    "template.tsx", "template.jsx", "default.tsx", "default.jsx",
]
ROLE_ROUTE_DIRS = ["pages", "routes", "controllers", "api", "endpoints"]
ROLE_WORKER_DIRS = ["workers", "tasks", "jobs", "queues"]
ROLE_CLIENT_STEMS = ["client", "sdk", "api_client", "api-client", "agent-client"]

# Modules, critical words, flags, refactor filter
MODULE_DIRS = ["src", "app", "lib", "packages", "modules", "core", "server", "client", "ui", "data", "feature"]
NESTED_MODULE_DIRS = ["src", "packages", "modules"]
CRITICAL_GRAPH = ["auth", "security", "payment", "db", "session", "alembic", "database", "login"]
CRITICAL_ANALYZER = ["auth", "payment", "db"]
CRITICAL_WORKER = ["auth", "db", "session", "payment", "security"]
FLAG_WORDS = ["launchdarkly", "unleash", "openfeature", "feature_flag", "flags.py", "featureflags"]
DEPLOY_WORDS = ["dockerfile", "docker-compose", "k8s/", "kubernetes", "helm", "terraform", ".tf", "deployment.yaml"]
REFACTOR_SKIP_DIRS = [".idea/", ".gradle/", "build/", ".vscode/", "gradle/"]
REFACTOR_SKIP_ENDINGS = [".png", ".webp", ".jpg", ".jpeg", ".ico", ".svg", ".jar", ".aar", ".bak", ".iml", "~"]
INTERNAL_ROOTS = ["app", "features", "components", "lib", "types", "services", "models", "utils", "core", "domain"]
EXTERNAL_ROOTS = ["android.", "java.", "javax.", "kotlin.", "kotlinx.", "androidx.", "react", "next", "@"]
DB_BASES = ["Base", "Model", "RoomDatabase", "Entity"]

# What counts as a package, import, class, function, method and table in Kotlin and Java; results hang on the
# exact expressions
KOTLIN_PACKAGE = r"(?m)^\s*package\s+([a-zA-Z0-9_.]+)"
KOTLIN_IMPORT = r"^\s*import\s+([a-zA-Z0-9_.*]+)(?:\s+as\s+([a-zA-Z0-9_]+))?"
KOTLIN_CLASS = r"(?m)^\s*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:data|sealed|abstract|enum|open|inner)\s+)*(?:class|interface|object)\s+([a-zA-Z0-9_]+)(?:\s*<[^>]*>)?(?:\s*:\s*([^{]+))?"
KOTLIN_FUN = r"(?m)^\s*(?:@(\w+)(?:\([^)]*\))?\s+)*fun\s+(?:<[^>]*>\s+)?([a-zA-Z0-9_]+)\s*\("
KOTLIN_TABLE = r'@Entity\s*\(\s*tableName\s*=\s*"([^"]+)"'
JAVA_PACKAGE = r"(?m)^\s*package\s+([a-zA-Z0-9_.]+);"
JAVA_IMPORT = r"^\s*import\s+(?:static\s+)?([a-zA-Z0-9_.*]+);"
JAVA_CLASS = r"(?m)^\s*(?:public|protected|private|abstract|static|final|\s)*\s*(?:class|interface|enum)\s+([a-zA-Z0-9_]+)"
JAVA_METHOD = r"(?m)^\s*(?:public|protected|private|static|final|\s)*\s*[\w<>\[\]]+\s+([a-zA-Z0-9_]+)\s*\([^)]*\)\s*(?:throws\s+[\w,\s]+)?\s*\{"

# Include statements of Gradle settings
GRADLE_INCLUDE = r"""include\s*\(?['":]([a-zA-Z0-9_\-:]+)['"]?\)?|\binclude\s+['"]([^'"]+)['"]"""

# Suffixes that an analysis counts as source
SUPPORTED_SOURCE = [".kt", ".kts", ".java", ".ts", ".tsx", ".js", ".jsx", ".py", ".rs", ".go", ".c", ".cpp", ".cs"]

# What the quality gate says of an analysis
GATE_EXPLANATIONS = {
    "FULL": "Complete deterministic evidence from Git diff, multi-language AST, and dependency graph topology.",
    "DEGRADED": "Analysis quality is degraded: AST parsing or graph topology is partial; risk score derived from Git diff.",
    "FAILED": "Core language parsing failed. Source dependency analysis and health scoring are unavailable.",
}

"""Good-practice rules: libraries in use and protective code that is present."""

from __future__ import annotations

from .model import Rule, has, lacks, numbered

MOBILE, VUE, BACKEND, REACT = ("react-native", "expo"), ("vue3", "nuxt3"), ("fastify", "node"), ("react", "node")
TESTS = has(path=[".test.", ".spec."])


def _good(title, category, *where, pattern=None, **extra) -> Rule:
    return Rule(
        rule_id="", family="practices", polarity="good", title=title, category=category, where=tuple(where),
        pattern=pattern, more_than=0 if pattern else None, line_zero=True, snippet="none", status="", **extra,
    )


def _libraries(category, table, title="{}", **extra) -> list[Rule]:
    return [_good(title.format(name), category, has(imports=sources), **extra) for name, sources in table]


def _first_library(category, table, title, field="imports") -> list[Rule]:
    """Only the first library of the list that a file imports is reported."""
    rules, earlier = [], []
    for name, sources in table:
        where = [has(**{field: sources})] + ([lacks(**{field: list(earlier)})] if earlier else [])
        rules.append(_good(title.format(name), category, *where))
        earlier += sources
    return rules


def _validation(name: str, earlier: list[str]) -> Rule:
    where = [has(imports=[name], import_prefix=[name + "/"])]
    if earlier:
        where.append(lacks(imports=earlier, import_prefix=[e + "/" for e in earlier]))
    return _good(f"Input Validation with {name}", "injection", *where)


# Libraries by topic (title, import sources).
VALIDATION = [
    ("Zod Schema Validation", ["zod"]), ("Yup Schema Validation", ["yup"]),
    ("Joi Schema Validation", ["joi", "@hapi/joi"]), ("Valibot Validation", ["valibot"]),
    ("Class Validator", ["class-validator"]), ("AJV JSON Schema Validation", ["ajv"]),
    ("Express Validator", ["express-validator"]),
]
QUERY_LAYERS = [("Prisma ORM Usage", ["@prisma/client"]), ("TypeORM Usage", ["typeorm"]), ("Knex.js Query Builder", ["knex"])]
HASHING = [("Bcrypt Password Hashing", ["bcrypt", "bcryptjs"]), ("Argon2 Password Hashing", ["argon2"])]
HEADERS = [
    ("CSP Header", "Content-Security-Policy"), ("X-Frame-Options", "X-Frame-Options"),
    ("X-Content-Type-Options", "X-Content-Type-Options"), ("HSTS Header", "Strict-Transport-Security"),
    ("XSS Protection", "X-XSS-Protection"),
]
RATE_LIMITERS = [
    ("Fastify Rate Limit", ["@fastify/rate-limit"]), ("Express Rate Limit", ["express-rate-limit"]),
    ("Rate Limiter Flexible", ["rate-limiter-flexible"]), ("Upstash Rate Limit", ["@upstash/ratelimit"]),
]
STORAGE = [
    ("Expo SecureStore", ["expo-secure-store"]), ("React Native Keychain", ["react-native-keychain"]),
    ("Encrypted Storage", ["react-native-encrypted-storage"]), ("Secure LocalStorage", ["secure-ls"]),
]
LOGIN_LIBRARIES = [
    ("Passport.js", "passport"), ("Auth.js", "@auth/core"), ("NextAuth", "next-auth"), ("Nuxt Auth Utils", "nuxt-auth-utils"),
]
FIRST_VALIDATORS = ["zod", "yup", "joi", "validator", "express-validator"]
FIRST_HASHERS = [("bcrypt", ["bcrypt"]), ("bcrypt.js", ["bcryptjs"]), ("Argon2", ["argon2"]), ("scrypt", ["scrypt"])]
FIRST_AUTHORISERS = [
    ("CASL ABAC", ["casl"]), ("CASL Ability", ["@casl/ability"]), ("AccessControl RBAC", ["accesscontrol"]),
    ("Casbin Authorization", ["casbin"]), ("Passport.js Authentication", ["passport"]),
]
FIRST_LOGGERS = [(name, [name]) for name in ("winston", "pino", "bunyan", "log4js")]

_PURIFY = has(imports=["dompurify", "isomorphic-dompurify"])
_LIMIT_NAMES = [source for name, sources in RATE_LIMITERS if "Rate Limit" in name for source in sources]

RULES = numbered("POS", [
    # beside the injection rules
    _good("DOMPurify Sanitization", "injection", _PURIFY),
    _good("Parameterized SQL Query", "injection",
          pattern=r"""\.query\s*\(\s*(?:`[^`]*`|"[^"\n]*"|'[^'\n]*'|[\w.$]+)\s*,\s*\[""", on="code", gate=(".query",)),
    *[_validation(name, FIRST_VALIDATORS[:i]) for i, name in enumerate(FIRST_VALIDATORS)],
    # beside the crypto rules
    *_first_library("crypto", FIRST_HASHERS, "Secure Password Hashing with {}"),
    _good("Cryptographically Secure Random Generation", "crypto", has(content=["randomBytes", "randomUUID"])),
    _good("Secrets from Environment Variables", "crypto",
          pattern=r"(?i)process\.env\.[A-Z_]*(?:KEY|SECRET|TOKEN|PASSWORD|API)|import\.meta\.env\.[A-Z_]*(?:KEY|SECRET|TOKEN|PASSWORD)",
          gate=(".env.",)),
    # beside the access rules
    *_first_library("access_control", FIRST_AUTHORISERS, "Authorization Library: {}", field="import_part"),
    _good("Authentication Middleware", "access_control", has(content=["preHandler"]),
          has(content=["authenticate", "verifyToken", "requireAuth"])),
    _good("Secure Cookie Configuration", "access_control", has(content=["httpOnly: true"]), has(content=["secure: true"])),
    _good("CORS with Specific Origins", "access_control",
          pattern=r"""cors\s*\(\s*\{[^}]*origin\s*:\s*\[['"][^*]""", gate=("cors", "origin")),
    # beside the misconfiguration rules
    _good("Security Headers with Helmet", "misconfiguration", has(imports=["helmet", "@fastify/helmet"])),
    *_first_library("misconfiguration", FIRST_LOGGERS, "Production Logger: {}"),
    _good("Centralized Error Handler", "misconfiguration", has(content=["setErrorHandler", "errorHandler"])),
    _good("Environment-Aware Configuration", "misconfiguration", has(content=["process.env.NODE_ENV"])),
    # validation, queries, hashing, headers, limits, storage
    *_libraries("input_validation", VALIDATION),
    _good("Parameterized PostgreSQL Queries", "injection", pattern=r"\.query\s*\([^)]*\$[0-9]+", gate=(".query", "$")),
    _good("Parameterized MySQL Queries", "injection", pattern=r"\.query\s*\([^)]*\?|\.execute\s*\([^)]*\?", gate=("?",)),
    *_libraries("injection", QUERY_LAYERS),
    _good("Drizzle ORM Usage", "injection", has(import_part=["drizzle-orm"])),
    *_libraries("cryptographic_failures", HASHING),
    _good("Scrypt Password Hashing", "cryptographic_failures", has(content=["scrypt"], import_part=["scrypt"])),
    _good("Helmet Security Headers", "security_misconfiguration", has(imports=["helmet", "@fastify/helmet"])),
    *[_good(f"{name} Implementation", "security_misconfiguration", has(content=[header])) for name, header in HEADERS],
    *_libraries("security_misconfiguration", RATE_LIMITERS),
    _good("Rate Limiting Implementation", "security_misconfiguration", has(content=["rateLimit", "rateLimiter"]),
          lacks(imports=_LIMIT_NAMES)),
    *_libraries("cryptographic_failures", STORAGE),
    # error handling, tests, content policy, login
    _good("React Error Boundary", "security_misconfiguration", has(content=["ErrorBoundary", "componentDidCatch"])),
    _good("Vue Error Handler", "security_misconfiguration", has(content=["app.config.errorHandler", "onErrorCaptured"])),
    _good("Fastify Error Handler", "security_misconfiguration", has(content=["setErrorHandler"])),
    _good("Express Error Middleware", "security_misconfiguration", has(content=["err, req, res, next"])),
    _good("XSS Testing", "injection", TESTS, has(content=["<script>", "XSS", "xss"])),
    _good("SQL Injection Testing", "injection", TESTS,
          has(content=["SQL injection", "sqlinjection", "'; DROP", "OR 1=1"])),
    _good("Authentication Testing", "access_control", TESTS, has(content=["unauthorized", "401", "403"])),
    _good("CSP Meta Tag", "injection", has(content=['http-equiv="Content-Security-Policy"'])),
    _good("CSP with Nonce", "injection", has(content=["nonce-"])),
    _good("Nuxt CSP Configuration", "injection", has(content=["csp:"]), has(path=["nuxt.config"])),
    _good("JWT Token Verification", "access_control", has(imports=["jsonwebtoken", "jose"]),
          has(content=["verify", "jwtVerify"])),
    *[_good(f"{name} Authentication", "access_control", has(import_prefix=[source])) for name, source in LOGIN_LIBRARIES],
    _good("Multi-Factor Authentication", "access_control",
          has(import_part=["totp", "2fa", "otp"], content=["twoFactor", "mfa", "authenticator"])),
    _good("Session Management", "access_control", has(import_part=["session"])),
    # mobile
    _good("Secure Storage with expo-secure-store", "mobile", has(imports=["expo-secure-store"]), frameworks=MOBILE),
    _good("Secure Credentials with react-native-keychain", "mobile", has(imports=["react-native-keychain"]), frameworks=MOBILE),
    _good("Biometric Authentication", "mobile",
          has(imports=["expo-local-authentication", "react-native-biometrics", "react-native-touch-id"]), frameworks=MOBILE),
    _good("Development-Only Guards", "mobile", has(content=["if (__DEV__)", "__DEV__ &&"]), frameworks=MOBILE),
    _good("SSL Certificate Pinning", "mobile", has(imports=["react-native-ssl-pinning"], content=["sslPinning"]), frameworks=MOBILE),
    _good("Deep Link Validation", "mobile", has(content=["allowedSchemes", "validateUrl", "isValidDeepLink"]), frameworks=MOBILE),
    # vue and nuxt
    _good("XSS Prevention with DOMPurify", "vue_nuxt", _PURIFY, frameworks=VUE),
    _good("Validated Server Input", "vue_nuxt", has(path=["server/"]),
          has(content=["readValidatedBody", "getValidatedQuery"]), frameworks=VUE),
    _good("Proper Route Abort", "vue_nuxt", has(path=["middleware/"]), has(content=["abortNavigation"]), frameworks=VUE),
    _good("Runtime Configuration", "vue_nuxt", has(content=["useRuntimeConfig()"]), frameworks=VUE),
    _good("Server-Only Code Isolation", "vue_nuxt", has(content=["#imports"]), has(content=["server"]), frameworks=VUE),
    # fastify and node
    _good("Schema Validation", "input_validation", has(content=["schema:"]), has(content=["body:"]), frameworks=BACKEND),
    _good("Rate Limiting", "security_misconfiguration",
          has(imports=["@fastify/rate-limit"], content=["rateLimit"]), frameworks=BACKEND),
    _good("Security Headers (Helmet)", "security_misconfiguration",
          has(imports=["@fastify/helmet", "helmet"], content=["helmet"]), frameworks=BACKEND),
    _good("Authentication Hooks", "access_control", has(content=["preHandler"]), has(content=["auth", "verify"]), frameworks=BACKEND),
    _good("Environment Variables for Credentials", "cryptographic_failures",
          has(content=["process.env.DATABASE", "process.env.DB_", "process.env.REDIS", "process.env.KAFKA"]), frameworks=BACKEND),
    _good("Parameterized Queries", "injection", has(content=["$1", "$2", "?"]), has(content=[".query(", "execute("]), frameworks=BACKEND),
    _good("Configured CORS", "access_control", has(content=["@fastify/cors", "cors"]), has(content=["origin:"]),
          lacks(content=["origin: '*'", 'origin: "*']), frameworks=BACKEND),
    _good("Input Sanitization", "injection",
          has(import_part=["sanitize", "xss", "validator"], content=["sanitize", "escape"]), frameworks=BACKEND),
    # react
    _good("HTML Sanitization with DOMPurify", "input_validation", _PURIFY, frameworks=REACT),
    _good("React Error Boundary", "error_handling", has(content=["componentDidCatch", "ErrorBoundary"]), frameworks=REACT),
    _good("Content Security Policy", "headers", has(content=["Content-Security-Policy", "contentSecurityPolicy"]), frameworks=REACT),
    _good("CSRF Token Implementation", "csrf_protection", has(content=["csrf", "X-XSRF-TOKEN", "X-CSRF-TOKEN"]), frameworks=REACT),
    _good("URL Validation", "input_validation", has(content=["isValidUrl", "validateUrl", "sanitizeUrl"]), frameworks=REACT),
    _good("React Helmet for Security Headers", "headers", has(imports=["react-helmet", "react-helmet-async"]), frameworks=REACT),
    _good("Authentication State Check", "auth", has(content=["useAuth"]), has(content=["isAuthenticated", "isLoggedIn"]), frameworks=REACT),
    _good("Secure Cookie Configuration", "cookies", has(content=["httpOnly", "sameSite", "Secure"]), frameworks=REACT),
])

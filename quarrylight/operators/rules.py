"""The scan rules, categories, severities and the notes on risky calls."""

from __future__ import annotations

from dataclasses import dataclass, replace

SEVERITIES = ("critical", "high", "medium", "low", "info")
CATEGORIES = (
    ("full-urls", "Full URLs"), ("endpoints", "Endpoints"), ("routes", "Routes"), ("ips", "IPs"), ("secrets", "Secrets"),
    ("emails", "Emails"), ("vulnerabilities", "Vulns"), ("storage", "Storage"), ("files", "Files"), ("libraries", "Libraries"),
    ("integrations", "Integrations"), ("taint", "Taint Flows"), ("dynamic", "Dynamic"), ("subdomains", "Subdomains"),
)


@dataclass(frozen=True)
class Rule:
    """One detector: the value is the first non-empty of groups, else the whole match.

    need: if given, one of these texts must occur (in lower case where the rule
    ignores case); texts without any are not searched.
    """

    id: str
    pattern: str
    label: str
    category: str
    severity: str
    confidence: str
    groups: tuple[int, ...] = ()
    ignore_case: bool = True
    enabled: bool = True
    exploit: bool = False
    exploit_key: str | None = None
    need: tuple[str, ...] = ()


# Identifiers, patterns, labels, severities and confidences of the rules. <b> is an ASCII word boundary,
# <z> the end of the text; quoted alternatives stand for a back-reference to the opening quote.
RULES: tuple[Rule, ...] = (
    Rule("urls", r"""(?:https?://|wss?://|ftp://)(?:localhost|\d{1,3}(?:\.\d{1,3}){3}|[a-zA-Z0-9.\-]+(?:\.[a-zA-Z]{2,})+)(?::\d{1,5})?(?:/[^\s"'<>`]*)?|"(/[a-zA-Z0-9\-_~.\/%]+)"|'(/[a-zA-Z0-9\-_~.\/%]+)'""", "Endpoint/URL", "urls", "info", "high", (1, 2), need=("/",)),
    Rule("linkfinder", r"""(?:"|')(((?:[a-zA-Z]{1,10}://|//)[^"'/]{1,}\.[a-zA-Z]{2,}[^"']{0,})|((?:/|\.\./|\./)[^"'><,;| *()(%$^/\\\[\]][^"'><,;|()]{1,})|([a-zA-Z0-9_\-/]{1,}/[a-zA-Z0-9_\-/]{1,}\.(?:[a-zA-Z]{1,4}|action)(?:[\?|#][^"|']{0,}|))|([a-zA-Z0-9_\-/]{1,}/[a-zA-Z0-9_\-/]{3,}(?:[\?|#][^"|']{0,}|))|([a-zA-Z0-9_\-]{1,}\.(?:php|asp|aspx|jsp|json|action|html|js|txt|xml)(?:[\?|#][^"|']{0,}|)))(?:"|')""", "LinkFinder Endpoint", "urls", "info", "high", (2, 1)),
    Rule("ipv4", r"<b>(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)<b>", "IPv4 Address", "ips", "medium", "high", ignore_case=False, need=(".",)),
    Rule("emails", r"<b>[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}<b>", "Email Address", "emails", "low", "high", ignore_case=False, need=("@",)),
    Rule("aws-access-key", r"(?:^|[^A-Za-z0-9])AKIA[0-9A-Z]{16}(?:[^A-Za-z0-9]|<z>)", "AWS Access Key", "secrets", "critical", "high", ignore_case=False, need=("AKIA",)),
    Rule("google-api-key", r"<b>AIza[0-9A-Za-z\-_]{35}<b>", "Google API Key", "secrets", "critical", "high", ignore_case=False, need=("AIza",)),
    Rule("github-token", r"<b>(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}<b>", "GitHub Token", "secrets", "critical", "high", ignore_case=False, need=("gh",)),
    Rule("slack-token", r"<b>xox[bposa]-[0-9a-zA-Z\-]{10,}<b>", "Slack Token", "secrets", "critical", "high", ignore_case=False, need=("xox",)),
    Rule("stripe-key", r"<b>(?:sk|pk|rk)_(?:live|test)_[0-9a-zA-Z]{10,}<b>", "Stripe Key", "secrets", "critical", "high", ignore_case=False, need=("k_",)),
    Rule("jwt-token", r"<b>eyJ[A-Za-z0-9\-_]{10,}\.eyJ[A-Za-z0-9\-_]{10,}\.[A-Za-z0-9\-_.+/=]{10,}", "JWT Token", "secrets", "high", "high", ignore_case=False, need=("eyJ",)),
    Rule("private-key", r"-----BEGIN\s(?:RSA\s|EC\s|DSA\s|OPENSSH\s)?PRIVATE\sKEY-----", "Private Key Block", "secrets", "critical", "high", ignore_case=False, need=("-----BEGIN",)),
    Rule("database-url", r"""<b>(?:mongodb(?:\+srv)?|postgres(?:ql)?|mysql|redis|amqp|mssql)://[^\s"'<>]+""", "Database Connection URL", "secrets", "critical", "high", need=("://",)),
    Rule("generic-secret", r"""[a-zA-Z0-9_]*?(?:bearer|token|apikey|api_key|secret|password|passwd|auth_token|access_token|client_secret|app_secret|_key|crypto|encrypt|decrypt|signing|master_key|session_key)[a-zA-Z0-9_]*\s*[:=]\s*(?:"([^"'\r\n]{10,})"|'([^"'\r\n]{10,})')""", "Generic Secret/Token", "secrets", "high", "medium", (1, 2), need=("bearer", "token", "apikey", "secret", "passw", "_key", "crypt", "signing")),
    Rule("bearer-concat", r"""["']Bearer\s*["']\s*\.?\s*(?:concat|[+])\s*\(\s*["']([a-f0-9]{32,})["']\s*\)|["']Bearer\s+([a-zA-Z0-9._\-]{20,})["']""", "Hardcoded Bearer Token", "secrets", "critical", "high", (2, 1), need=("bearer",)),
    Rule("authorization-header", r"""[Aa]uthorization\s*[:=]\s*["'`](?:Bearer|Basic|Token)\s+[a-zA-Z0-9._+/\-]{20,}["'`]|[Aa]uthorization\s*[:=]\s*["'`](?:Bearer|Basic|Token)\s*["'`]\s*\.?\s*(?:concat|[+])\s*\(\s*["'`]([a-zA-Z0-9._+/\-]{20,})["'`]""", "Hardcoded Authorization Header", "secrets", "critical", "high", (1,), need=("authorization",)),
    Rule("long-hex-token", r"""["']([a-f0-9]{64,})["']""", "Long Hex Token", "secrets", "high", "medium", (1,)),
    Rule("dom-sinks", r"(innerHTML|outerHTML|document\.write|document\.writeln|eval|setTimeout|setInterval|Function)\s*\(", "DOM Sink (XSS Risk)", "vulnerabilities", "high", "high", (1,), exploit=True, need=("(",)),
    Rule("inner-html-assign", r"\.innerHTML\s*[+]?=", "innerHTML Assignment", "vulnerabilities", "high", "high", exploit=True, exploit_key="innerhtml", need=("innerhtml",)),
    Rule("postmessage", r"""\.postMessage\s*\(|addEventListener\s*\(\s*["']message["']""", "postMessage Usage", "vulnerabilities", "medium", "high", exploit=True, need=("postmessage", "addeventlistener")),
    Rule("prototype-pollution", r"__proto__\s*[\[.]|\.constructor\s*\[|prototype\s*\[", "Prototype Pollution Risk", "vulnerabilities", "high", "medium", exploit=True, exploit_key="__proto__", need=("proto", "constructor")),
    Rule("react-dangerous", r"dangerouslySetInnerHTML", "React dangerouslySetInnerHTML", "vulnerabilities", "high", "high", exploit=True, exploit_key="dangerouslysetinnerhtml", need=("dangerously",)),
    Rule("angular-bypass", r"bypassSecurityTrust\w+", "Angular Security Bypass", "vulnerabilities", "high", "high", exploit=True, exploit_key="bypasssecuritytrust", need=("bypasssecurity",)),
    Rule("storage-access", r"(?:localStorage|sessionStorage)\s*\.\s*(?:getItem|setItem|removeItem|clear)\s*\(|(?:localStorage|sessionStorage)\s*\[", "Client Storage Access", "storage", "medium", "high", exploit=True, exploit_key="localstorage", need=("storage",)),
    Rule("cookie-access", r"document\.cookie\s*[=]", "Cookie Manipulation", "storage", "medium", "high", exploit=True, exploit_key="document.cookie", need=("document.cookie",)),
    Rule("sensitive-files", r"""["'][^"'\s]{1,100}\.(?:env|bak|sql|csv|log|conf|ya?ml|xml|pem|key|cert|crt|old|orig|backup|dump|db|sqlite|htpasswd|htaccess|DS_Store|npmrc)['"]""", "Sensitive File Reference", "files", "medium", "medium", need=(".",)),
    Rule("internal-paths", r"""["'](?:/etc/(?:passwd|shadow|hosts|nginx)|/var/(?:log|www|tmp)|/proc/|/root/|C:\\\\(?:Windows|Users|Program))[^"']*["']""", "Internal Path Reference", "files", "high", "medium"),
    Rule("source-maps", r"//#\s*sourceMappingURL=\S+", "Source Map Reference", "files", "medium", "high", need=("sourcemappingurl",)),
    Rule("integrations", r"(?:stripe\.com|firebaseio\.com|firebase\.google\.com|amazonaws\.com|mixpanel\.com|datadoghq\.com|sentry\.io|algolia\.net|segment\.(?:com|io)|intercom\.io|zendesk\.com|twilio\.com|sendgrid\.net|mailgun\.(?:net|com)|cloudinary\.com|pusher\.com|pubnub\.com|launchdarkly\.com|supabase\.(?:co|io)|auth0\.com|okta\.com|clerk\.dev)", "Third-Party Service", "integrations", "info", "high", need=(".",)),
    Rule("cloud-storage", r"(?:[a-zA-Z0-9\-_.]+\.s3[.\-](?:us|eu|ap|sa|ca|me|af|cn)?[a-z0-9\-]*\.?amazonaws\.com|s3\.amazonaws\.com/[a-zA-Z0-9\-_.]+|storage\.googleapis\.com/[a-zA-Z0-9\-_.]+|[a-zA-Z0-9\-_.]+\.storage\.googleapis\.com|[a-zA-Z0-9\-_.]+\.blob\.core\.windows\.net)", "Cloud Storage URL", "full-urls", "medium", "high", exploit=True, exploit_key="cloudstorage", need=("amazonaws", "googleapis", "windows.net")),
    Rule("oauth-redirect", r"""redirect[_-]?uri\s*[:=]\s*["']([^"'\s]{10,})["']""", "OAuth Redirect URI", "secrets", "high", "medium", (1,), need=("redirect",)),
    Rule("debug-flags", r"""(?:debug|devMode|debugMode|dev_mode|DEBUG_MODE|isDebug|isDev|enableDebug|debugEnabled|isProduction|NODE_ENV)\s*[:=]\s*(?:true|false|["'](?:development|staging|test)["'])""", "Debug/Dev Flag", "vulnerabilities", "low", "medium", need=("debug", "dev", "production", "node_env")),
    Rule("graphql-ops", r"(?:query|mutation|subscription)\s+[A-Z][a-zA-Z0-9_]*\s*(?:\([^)]*\))?\s*\{|\{\s*(?:__schema|__type)\s*\{", "GraphQL Operation", "endpoints", "info", "high", need=("{",)),
    Rule("cors-wildcard", r"""Access-Control-Allow-Origin\s*[:=]\s*["']?\*["']?|cors\s*[:=]\s*(?:true|\{[^}]*origin\s*:\s*(?:true|\*|["']\*["']))""", "CORS Wildcard/Misconfiguration", "vulnerabilities", "medium", "medium", exploit=True, exploit_key="corswildcard", need=("access-control", "cors")),
    Rule("hardcoded-password", r"""(?:password|passwd|pwd)\s*[:=]\s*["']([^"'\r\n]{4,})["']""", "Hardcoded Password", "secrets", "critical", "medium", (1,), need=("passw", "pwd")),
    Rule("webpack-chunks", r"""(?:__webpack_require__|webpackJsonp|__webpack_modules__)\s*[.(\[]|["'][a-zA-Z0-9./\-_]*\.chunk\.js["']""", "Webpack Chunk Reference", "files", "info", "high", need=("webpack", ".chunk.js")),
)

# What is noise among URLs and endpoints (patterns on the cleaned value; the flag: case is ignored).
URL_NOISE: tuple[tuple[str, bool], ...] = (
    (r"node_modules|!\*{2,}|raw-loader|__webpack_|webpackJsonp|webpackChunk", False),
    (r"""\.(?:ts|tsx|jsx|scss|sass|css|html|json|map|svg|less|pug|styl)(?:["'\s]|<z>)""", True),
    (r"^\.{1,2}/", False),
    (r"\.(?:png|jpe?g|gif|ico|webp|bmp|woff2?|ttf|eot|otf|mp[34]|wav|ogg|webm|pdf)(?:\?.*)?<z>", True),
    (r"^data:|sourceMappingURL|sourcesContent", True),
    (r"^/\*|\*/<z>", False),
    (r"^/?(?:src|dist|build|lib|app|components|modules|services|utils|helpers|guards?|interceptors?|shared|core|assets|styles|environments)/", False),
    (r"^#", False),
)

#: What we say about risky calls: key -> (risk, description, exploit, mitigation).
EXPLOITS: dict[str, tuple[str, str, str, str]] = {
    "innerhtml": ("Critical", "Assigning to innerHTML turns text into live markup.", "<img src=x onerror=alert(1)>", "Assign textContent, or sanitise the markup first."),
    "document.write": ("Critical", "Writes raw markup into the page while it loads.", "<script>alert(1)</script>", "Build elements through the DOM interface."),
    "document.writeln": ("Critical", "Writes a line of raw markup into the page.", "<script>alert(1)</script>", "Build elements through the DOM interface."),
    "eval": ("Critical", "Runs any text as code.", "eval('alert(1)')", "Parse data with JSON.parse; keep code out of data."),
    "settimeout": ("High", "A text argument is run as code.", "setTimeout('alert(1)', 0)", "Pass a function."),
    "setinterval": ("High", "A text argument is run as code again and again.", "setInterval('alert(1)', 9)", "Pass a function."),
    "function": ("High", "The constructor compiles text into code.", "new Function('alert(1)')()", "Write the function out, or look it up by name."),
    "postmessage": ("Medium", "Messages may come from or go to any origin.", "postMessage('x', '*')", "Name the target origin and check the sender's."),
    "localstorage": ("Medium", "Any script on the page can read what is stored.", "localStorage.getItem('token')", "Keep credentials in HttpOnly cookies."),
    "sessionstorage": ("Medium", "Any script on the page can read what is stored in the tab.", "sessionStorage.getItem('token')", "Keep credentials on the server."),
    "document.cookie": ("High", "Scripts read and change cookies that aren't HttpOnly.", "document.cookie", "Set HttpOnly, Secure and SameSite."),
    "dangerouslysetinnerhtml": ("High", "Inserts markup past the framework's escaping.", "{__html: input}", "Render text, or sanitise the markup first."),
    "bypasssecuritytrust": ("High", "Switches the framework's sanitiser off for a value.", "bypassSecurityTrustHtml(input)", "Let the sanitiser work; validate the input."),
    "__proto__": ("High", "Keys from input may change the prototype of all objects.", "o['__proto__'].admin = true", "Refuse such keys; use Map or null-prototype objects."),
    "cloudstorage": ("Medium", "A bucket may be open to the public.", "list the bucket without credentials", "Keep buckets private; hand out signed URLs."),
    "corswildcard": ("Medium", "Any site may read the answers of this interface.", "fetch(target, {credentials: 'include'})", "List the origins that are allowed."),
}


def with_settings(rules: tuple[Rule, ...] = RULES, enabled: dict[str, bool] | None = None, strict: bool = False) -> tuple[Rule, ...]:
    """Rules with their switches set. strict: Function and AWS keys without the two known false matches."""
    out = tuple(replace(r, enabled=(enabled or {}).get(r.id, r.enabled)) for r in rules)
    if not strict:
        return out
    tight = {
        "dom-sinks": r"(?i:(innerHTML|outerHTML|document\.write|document\.writeln|eval|setTimeout|setInterval))\s*\(|(Function)\s*\(",
        "aws-access-key": r"(?:^|[^A-Za-z0-9])(AKIA[0-9A-Z]{16})(?:[^A-Za-z0-9]|<z>)",
    }
    fix = {"dom-sinks": {"groups": (1, 2), "ignore_case": False, "need": ()}, "aws-access-key": {"groups": (1,)}}
    return tuple(replace(r, pattern=tight[r.id], **fix[r.id]) if r.id in tight else r for r in out)


def register(rules: tuple[Rule, ...], *more: Rule) -> tuple[Rule, ...]:
    """Rules with own ones added, or put in place of those with the same id."""
    own = {r.id: r for r in more}
    return (*(own.pop(r.id, r) for r in rules), *own.values())

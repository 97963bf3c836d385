"""Word lists, patterns, labels and defaults the results depend on.

Everything in this module is data that has to be exactly as it is for results
to be right. No logic lives here.
"""

# --- Defaults -------------------------------------------------------------

CONTAMINATION = 0.15
DBSCAN_EPS = 0.8
DBSCAN_MIN_SAMPLES = 2
SEMANTIC_EPS = 0.35
SEMANTIC_MIN_SAMPLES = 1
SEED = 42
LARGE_LOG_CLUSTERS = 8
LARGE_LOG_ROWS = 10_000
SEMANTIC_TEMPLATES = 5000
FOREST_TREES = 150
FOREST_SUBSAMPLE = 256
TFIDF_ROW_TERMS = 256
TFIDF_SEMANTIC_TERMS = 384
SVD_COMPONENTS = 50
MATCH_THRESHOLD = 0.5
MAX_MESSAGE_CHARS = 10_000
TRUNCATION_MARK = " ...[TRUNCATED]"
EMPTY_TEMPLATE = "[EMPTY_LOG]"
EMPTY_TEXT = "[EMPTY]"

# --- Severity -------------------------------------------------------------

SEVERITY_ORDER = ["DEBUG", "INFO", "WARNING", "WARN", "ERROR", "CRITICAL", "FATAL"]
SEVERITY_WEIGHT = {
    "DEBUG": 0,
    "INFO": 1,
    "WARNING": 2,
    "WARN": 2,
    "ERROR": 3,
    "CRITICAL": 4,
    "FATAL": 4,
}
ERROR_LEVELS = ["ERROR", "CRITICAL", "FATAL"]
CRITICAL_LEVELS = ["CRITICAL", "FATAL"]
ALERT_LEVELS = ["WARNING", "WARN", "ERROR", "CRITICAL", "FATAL"]

# --- Patterns (java.util.regex; (?U) gives the Unicode classes) -------------

LEVEL_WORDS = "DEBUG|INFO|WARNING|WARN|ERROR|CRITICAL|FATAL"
STRICT_LEVEL_WORDS = "INFO|ERROR|WARNING|CRITICAL|DEBUG"
DATE_MASK = r"\b\d{4}[-/]\d{2}[-/]\d{2}\b"
TIME_MASK = r"\b\d{2}:\d{2}:\d{2}(?:\.\d+)?\b"
IP_MASK = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
HEX_MASK = r"\b0x[0-9a-fA-F]+\b"
NUM_MASK = r"\b\d+\b"
TERM_PATTERN = r"\b\w\w+\b"
# White space: the Unicode property plus the four ASCII separators 0x1c-0x1f.
WS = r"[\s\x1c-\x1f]"

# --- Diagnosis labels (kept in the language of the stored data) --------------

NORMAL_CAUSE = "Comportamiento normal"
NORMAL_ACTION = "No requiere accion"
UNKNOWN_CAUSE = "Anomalia detectada (comportamiento atípico no clasificado)"
UNKNOWN_ACTION = (
    "Revisar logs cercanos y realizar un análisis de trazas para identificar el "
    "origen de este comportamiento anómalo."
)

# Keyword rules in priority order: family, keywords, cause.
CAUSE_RULES = [
    (
        "DB",
        ["database", "db", "sql", "connection failed", "timeout", "query", "deadlock"],
        "Caída, saturación o interbloqueo en Base de Datos",
    ),
    (
        "NET",
        ["network", "connection", "unreachable", "refused", "tcp", "udp", "ospf", "bgp",
         "ftp", "http", "socket", "port", "interface", "link down"],
        "Falla de red, protocolo inestable o pérdida de conexión",
    ),
    (
        "DISK",
        ["disk", "filesystem", "no space", "failure", "io error", "write", "read"],
        "Falla de disco, saturación de I/O o falta de espacio",
    ),
    (
        "RES",
        ["cpu", "memory", "oom", "usage high", "heap", "segfault", "killed"],
        "Saturacion de recursos (CPU/RAM) o proceso finalizado por OOM",
    ),
    (
        "AUTH",
        ["auth", "login", "permission", "denied", "unauthorized", "invalid token", "password"],
        "Fallo de autenticacion o permisos insuficientes",
    ),
    (
        "CONF",
        ["config", "syntax", "invalid value", "missing key", "parse error", "yaml"],
        "Error en configuración o formato inválido",
    ),
    (
        "SVC",
        ["service", "daemon", "crashed", "exited", "stopped", "fatal"],
        "Caída crítica de servicio o demonio (Crash)",
    ),
]

ACTION_DB = "Verificar disponibilidad del motor SQL, estado del pool de conexiones y métricas de latencia."
ACTION_NET = "Validar conectividad física/lógica, estado del protocolo (OSPF/BGP), firewall y puertos."
ACTION_DISK = "Revisar logs SMART, espacio libre, inodes y posibles errores en el sistema de archivos."
ACTION_RES = "Inspeccionar picos de consumo (CPU/RAM), límites del SO (OOM Killer) y procesos zombis."
ACTION_AUTH = "Revisar rotación de credenciales, tokens vencidos, políticas IAM y bloqueos de IP."
ACTION_CONF = "Auditar los cambios recientes en archivos de configuración y validar sintaxis."
ACTION_SVC = "Revisar los core dumps, logs del sistema (journalctl) e intentar reiniciar el servicio."

# Key contained in the lower-cased cause, in priority order -> recommendation.
ACTION_KEYS = [
    ("base de datos", ACTION_DB),
    ("red", ACTION_NET),
    ("disco", ACTION_DISK),
    ("recursos", ACTION_RES),
    ("cpu", ACTION_RES),
    ("autenticacion", ACTION_AUTH),
    ("configuración", ACTION_CONF),
    ("servicio", ACTION_SVC),
]

# Knowledge base in priority order: family, pattern text, cause, recommendation.
KNOWLEDGE = [
    (
        "DB",
        "Database connection timeout pool exhausted sql query failure socket error database unreachable deadlock",
        "Caída, saturación o interbloqueo en Base de Datos",
        ACTION_DB,
    ),
    (
        "NET",
        "Network connection refused port unreachable host disconnected tcp udp ospf bgp ftp timeout link down interface",
        "Falla de red, protocolo inestable o pérdida de conexión",
        ACTION_NET,
    ),
    (
        "DISK",
        "Disk space full write failed filesystem read-only partition capacity limit out of disk io error",
        "Falla de disco, saturación de I/O o falta de espacio",
        ACTION_DISK,
    ),
    (
        "RES",
        "Out of memory error HeapSpace high CPU usage process killed server overload segfault system out of memory",
        "Saturación de CPU/RAM o proceso finalizado por OOM",
        ACTION_RES,
    ),
    (
        "AUTH",
        "Access denied unauthorized credentials expired token invalid login forbidden permission error password failure",
        "Fallo de autenticación o permisos insuficientes",
        ACTION_AUTH,
    ),
    (
        "CONF",
        "Syntax error invalid configuration missing key parse failure yaml format error",
        "Error en configuración o formato inválido",
        ACTION_CONF,
    ),
    (
        "SVC",
        "Service crashed daemon stopped fatal exit core dumped restart failed",
        "Caída crítica de servicio o demonio (Crash)",
        ACTION_SVC,
    ),
]

# --- Log domain keywords, in priority order ---------------------------------

DOMAINS = [
    ("Base de datos",
     ["database", "db", "sql", "mysql", "postgres", "oracle", "connection failed"]),
    ("Red / conectividad",
     ["network", "timeout", "unreachable", "refused", "socket", "connection"]),
    ("Disco / almacenamiento",
     ["disk", "filesystem", "volume", "space", "io error"]),
    ("Recursos del servidor",
     ["cpu", "memory", "oom", "heap", "usage high", "thread"]),
    ("Autenticacion",
     ["auth", "login", "permission", "denied", "token", "credential"]),
    ("Aplicacion web",
     ["http", "request", "response", "endpoint", "server", "service"]),
]
NO_DOMAIN = "Operacion general del servidor"

POSTURE_CRITICAL = "El archivo contiene eventos criticos que deben revisarse con prioridad alta."
POSTURE_DEGRADED = "El archivo muestra senales de degradacion o comportamiento inusual."
POSTURE_CALM = "El archivo no muestra senales fuertes de incidente con los filtros actuales."
FOCUS_ANOMALIES = "Prioriza las filas marcadas por ML y cruza su plantilla Drain con la causa raiz sugerida."
FOCUS_ERRORS = "Prioriza eventos ERROR/CRITICAL y revisa su repeticion por plantilla."
FOCUS_CALM = "Usa el explorador para validar patrones repetidos y establecer una linea base."
UNASSIGNED = "Sin asignar"

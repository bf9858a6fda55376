"""What a file path says: noise, evidence, owner, log source, writable place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spoorline.functions.text import (
    contains_any,
    ends_any,
    file_name,
    group,
    let,
    lookup,
    norm_path,
    or_blank,
    posix,
    strip_ws,
)

# Directories that ship the same on every host.
NOISE_DIRS = (
    "/etc/alternatives/", "/etc/apparmor.d/abstractions/", "/etc/apparmor.d/abi/",
    "/etc/apparmor.d/local/", "/etc/apparmor.d/tunables/", "/etc/ssl/certs/",
    "/usr/share/ca-certificates/", "/etc/ca-certificates/", "/etc/console-setup/",
    "/etc/dpkg/origins/", "/etc/sgml/", "/etc/newt/", "/etc/terminfo/", "/etc/logcheck/",
    "/etc/apt/trusted.gpg.d/", "/etc/apt/apt.conf.d/", "/etc/dbus-1/system.d/",
    "/etc/x11/xsession.d/", "/etc/vmware-tools/vgauth/schemas/",
    "/etc/rc0.d/", "/etc/rc1.d/", "/etc/rc2.d/", "/etc/rc3.d/", "/etc/rc4.d/",
    "/etc/rc5.d/", "/etc/rc6.d/", "/etc/rcs.d/",
    "/usr/lib/systemd/system/", "/lib/systemd/system/", "/usr/lib/systemd/user/",
    "/etc/emacs/", "/etc/vim/", "/etc/nanorc.d/", "/etc/bash_completion.d/",
    "/etc/kernel/", "/etc/modprobe.d/", "/etc/sysctl.d/", "/etc/udev/hwdb.d/",
)

# Endings that are never a timeline.
NOISE_SUFFIXES = (
    ".1.gz", ".2.gz", ".3.gz", ".4.gz", ".5.gz", ".6.gz", ".7.gz", ".8.gz",
    ".psf.gz", ".acm.gz", ".kmap.gz",
    ".gpg", ".pem", ".crt", ".cer", ".der", ".pub.asc",
    ".efi.signed", ".xsd", ".dtd", ".xsl",
    ".ttf", ".otf", ".woff", ".woff2", ".pyc", ".pyo", ".so", ".a", ".o",
    ".mo", ".pot", ".ico", ".png", ".jpg", ".gif", ".svg",
    ".service", ".target", ".socket", ".mount", ".automount", ".timer", ".path",
    ".slice", ".scope", ".device", ".swap", ".rules", ".preset", ".link", ".netdev",
)

# Names and directories that are evidence wherever they sit.
EVIDENCE_NAMES = (
    "passwd", "shadow", "group", "gshadow", "sudoers", "hosts", "hosts.allow",
    "hosts.deny", "crontab", "fstab", "resolv.conf", "nsswitch.conf", "hostname",
    "machine-id", "os-release", "issue", "motd", "shells", "securetty",
    "sshd_config", "ssh_config", "authorized_keys", "authorized_keys2",
    "known_hosts", "mongod.conf", "mongodb.conf", "my.cnf", "postgresql.conf",
    "pg_hba.conf", "redis.conf", "smb.conf", "nginx.conf", "httpd.conf",
    "apache2.conf", "php.ini", "docker-compose.yml", "daemon.json",
    "authorized_hosts", "netplan.yaml", "rsyslog.conf", "sysctl.conf",
    "ld.so.preload", "profile", "bashrc", "bash_history", "zsh_history",
    "mysql_history", "dbshell", "psql_history", "viminfo", "netrc", "rhosts",
)
EVIDENCE_DIRS = (
    "/etc/sudoers.d/", "/etc/cron.d/", "/etc/cron.daily/", "/etc/cron.hourly/",
    "/etc/cron.weekly/", "/etc/cron.monthly/", "/var/spool/cron/", "/etc/ssh/",
    "/root/.ssh/", "/.ssh/", "/etc/systemd/system/", "/etc/init.d/", "/etc/rc.local",
    "/etc/profile.d/",
)

# Path markers, most specific first, and the service they name.
LOG_SOURCES = (
    ("/var/log/mongodb/", "mongodb"),
    ("/var/log/postgresql/", "postgresql"),
    ("/var/log/mysql/", "mysql"),
    ("/var/log/redis/", "redis"),
    ("/var/log/nginx/", "nginx"),
    ("/var/log/apache2/", "apache"),
    ("/var/log/httpd/", "apache"),
    ("/var/log/amazon/ssm/", "amazon-ssm"),
    ("/var/log/amazon/", "amazon"),
    ("/var/log/unattended-upgrades/", "unattended-upgrades"),
    ("/var/log/landscape/", "landscape"),
    ("/var/log/sysstat/", "sysstat"),
    ("/var/log/apt/", "apt"),
    ("/var/log/audit/", "auditd"),
    ("/var/log/samba/", "samba"),
    ("/var/log/lxd/", "lxd"),
    ("/lxd/logs/", "lxd"),
    ("/var/log/journal/", "systemd-journal"),
    ("/live_response/process", "uac-live-response/process"),
    ("/live_response/network", "uac-live-response/network"),
    ("/live_response/packages", "uac-live-response/packages"),
    ("/live_response/containers", "uac-live-response/containers"),
    ("/live_response/hardware", "uac-live-response/hardware"),
    ("/live_response/storage", "uac-live-response/storage"),
    ("/live_response/system", "uac-live-response/system"),
    ("/live_response/", "uac-live-response"),
    ("/hash_executables/", "uac-hashes"),
)
LOG_NAMES = {
    "cloud-init.log": "cloud-init",
    "cloud-init-output.log": "cloud-init",
    "dpkg.log": "dpkg",
    "alternatives.log": "dpkg-alternatives",
    "kern.log": "kernel",
    "dmesg": "kernel",
    "apport.log": "apport",
    "ufw.log": "ufw",
    "fail2ban.log": "fail2ban",
    "mongod.log": "mongodb",
    "boot.log": "boot",
}

# Windows places any user can write to, trusted install roots, and
# vendor directories that do run under a profile.
USER_WRITABLE = (
    "\\appdata\\", "\\local\\temp\\", "\\windows\\temp\\",
    "\\programdata\\", "\\users\\public\\", "\\$recycle.bin", "\\perflogs\\",
)
TRUSTED_ROOTS = (
    "c:\\program files\\", "c:\\program files (x86)\\", "c:\\windows\\system32\\",
    "c:\\windows\\syswow64\\", "c:\\windows\\servicing\\", "c:\\windows\\winsxs\\",
    "c:\\windows\\explorer.exe", "c:\\windows\\immersivecontrolpanel\\",
    "c:\\windows\\microsoft.net\\",
)
KNOWN_USER_APPS = (
    "\\programdata\\microsoft\\windows defender\\",
    "\\programdata\\microsoft\\windows\\",
    "\\programdata\\package cache\\",
    "\\windows\\temp\\{",
    "\\appdata\\local\\microsoft\\teams\\", "\\appdata\\local\\microsoft\\onedrive\\",
    "\\appdata\\local\\google\\chrome\\", "\\appdata\\local\\google\\update\\",
    "\\appdata\\local\\slack\\", "\\appdata\\local\\discord\\",
    "\\appdata\\local\\programs\\microsoft vs code\\",
    "\\appdata\\local\\microsoft\\edgeupdate\\", "\\appdata\\local\\zoom\\",
    "\\appdata\\local\\clickshare\\", "\\appdata\\roaming\\zoom\\",
    "\\appdata\\local\\citrix\\", "\\appdata\\local\\gotomeeting\\",
    "\\appdata\\local\\microsoft\\edgewebview\\",
)


def is_evidence_config(path: Column) -> Column:
    """Configuration in which an intruder's changes would be visible."""
    return let(posix(path), _evidence)


def _evidence(text: Column) -> Column:
    bare = F.regexp_replace(F.substring_index(text, "/", -1), r"^\.", "")
    return bare.isin(*EVIDENCE_NAMES) | contains_any(text, EVIDENCE_DIRS)


def is_collector_noise(path: Column) -> Column:
    """Files a collector sweeps up that cannot carry a trace; evidence wins."""
    def judged(text: Column) -> Column:
        noise = (
            contains_any(text, [*NOISE_DIRS, "/man/man", "/locale/"])
            | ends_any(text, NOISE_SUFFIXES)
            | text.rlike(r"/[0-9a-f]{8}\.[0-9]+$")
        )
        return ~_evidence(text) & noise

    return let(posix(path), judged)


def history_owner(path: Column) -> Column:
    """``/home/<x>/…`` -> x; ``/root/.…`` -> root; else blank."""
    text = F.translate(path, "\\", "/")
    return or_blank(
        F.coalesce(
            group(text, r"(?:^|/)home/+([^/]+)"),
            F.when(text.rlike(r"(?:^|/)root/+\."), F.lit("root")),
        )
    )


def home_owner(path: Column) -> Column:
    """Whose home the path lies in; the first ``home`` or ``root`` part decides."""
    text = F.translate(path, "\\", "/")
    hit = F.regexp_extract(text, r"(?:^|/)(root(?=/|$)|home/+[^/]+)", 1)
    return F.when(hit == "root", hit).otherwise(F.regexp_replace(hit, "^home/+", ""))


def source_label(path: Column) -> Column:
    """``text/<service>`` from the path, else from the name, else the name itself."""
    def labelled(text: Column) -> Column:
        label = F.lit(None).cast("string")
        for marker, service in reversed(LOG_SOURCES):
            label = F.when(text.contains(marker), service).otherwise(label)
        return label

    name = file_name(path)
    shown = F.when(name == "", F.lit("text")).otherwise(F.left(name, F.lit(40)))
    return F.concat(
        F.lit("text/"),
        F.coalesce(let(posix(path), labelled), lookup(LOG_NAMES, F.lower(name)), shown),
    )


def in_user_writable(path: Column) -> Column:
    return contains_any(norm_path(path), USER_WRITABLE)


def in_trusted_root(path: Column) -> Column:
    return contains_any(norm_path(path), TRUSTED_ROOTS)


def is_known_user_app(path: Column) -> Column:
    return contains_any(norm_path(path), KNOWN_USER_APPS)


def suspect_place(path: Column) -> Column:
    """User-writable and not a known application's own directory."""
    return let(
        norm_path(path),
        lambda p: contains_any(p, USER_WRITABLE) & ~contains_any(p, KNOWN_USER_APPS),
    )


# --- names nobody chose -------------------------------------------------------

# Words found in names a person chose. A word that contains a
# shorter listed one is implied by it and left out.
NAME_WORDS = (
    "agent", "assist", "auth", "back", "boot", "broker", "cache", "cast", "client",
    "cloud", "config", "connect", "console", "core", "crash", "create", "data", "defend",
    "deploy", "desk", "detect", "diag", "disk", "driver", "edge", "engine", "enroll",
    "event", "experience", "explorer", "export", "firewall", "font", "frame", "graphic",
    "group", "health", "helper", "host", "hyper", "icon", "image", "index", "input",
    "install", "intel", "java", "kernel", "launch", "layout", "license", "load", "local",
    "locate", "mail", "maint", "manage", "media", "memory", "menu", "message", "micro",
    "mode", "monitor", "mount", "move", "node", "note", "notify", "office", "onedrive",
    "open", "package", "pair", "panel", "perf", "photo", "pick", "play", "plugin", "policy",
    "power", "present", "print", "push", "query", "queue", "reader", "ready", "realtek",
    "recovery", "remote", "render", "repair", "report", "resolve", "sample", "scan",
    "schedule", "search", "secure", "security", "sense", "sentinel", "server", "service",
    "session", "setting", "setup", "share", "shell", "signal", "snap", "sound", "speech",
    "spell", "spool", "start", "state", "status", "store", "stream", "support", "sync",
    "task", "team", "telemetry", "text", "theme", "thread", "time", "tool", "trace", "tray",
    "trust", "update", "upgrade", "user", "util", "vault", "video", "view", "virtual",
    "voice", "watch", "widget", "word", "work", "write", "zoom", "files", "folder", "soft",
    "credential", "platform", "roaming", "public", "repository", "feature", "current",
    "native", "version", "amd64", "nvidia", "google", "chrome", "adobe", "cisco", "razer",
    "servicing", "wbem", "assembly",
    "sys", "wow", "cmd", "run", "net", "log", "svc", "app", "exe", "dll", "msi", "x64",
    "x86", "reg", "api", "usb", "gpu", "ini", "tmp", "bin", "lib", "com", "job", "pnp",
    "wmi", "rpc", "dns", "win", "pro", "dev", "srv", "aud", "mgr",
)


def looks_machine_generated(name: Column, words: tuple[str, ...] = NAME_WORDS) -> Column:
    """A name like ``h2cgEzNCsypd``: no known word, and two of five odd traits."""
    either = "|".join(words)

    def judged(stem: Column) -> Column:
        mixed = stem.rlike("[A-Z]") & stem.rlike("[a-z]")
        letters = F.regexp_replace(stem, "[^A-Za-z]", "")
        others = F.regexp_replace(stem, "[^B-DF-HJ-NP-TV-XZb-df-hj-np-tv-xz]", "")
        # Vowels below 34 percent of the letters: consonants above 66.
        traits = [
            F.length(others) * 100 > F.length(letters) * 66,
            stem.rlike("(?i)[bcdfghjklmnpqrstvwxz]{4}"),
            stem.rlike("[A-Za-z][0-9]+[A-Za-z]"),
            mixed & stem.rlike("[0-9]"),
            mixed & (F.regexp_count(stem, F.lit("[a-z][A-Z]|[A-Z][a-z]")) >= 3),
        ]
        score = sum((t.cast("int") for t in traits[1:]), traits[0].cast("int"))
        return (
            stem.rlike("^[A-Za-z0-9_.-]{6,40}$")
            & stem.rlike("(?:[A-Za-z][^A-Za-z]*){5}")
            & ~stem.rlike("(?i)^[0-9a-f-]{8,}$")
            & (score >= 2)
            & ~F.lower(stem).rlike(either)
        )

    return let(F.regexp_replace(strip_ws(or_blank(name)), r"\.[a-z0-9]{1,4}$", ""), judged)


def random_segments(path: Column) -> Column:
    """Parts of a path that look machine-generated, in their own case."""
    bare = F.regexp_replace(strip_ws(or_blank(path)), '^"+|"+$', "")
    parts = F.split(F.translate(bare, "/", "\\"), r"\\")
    return F.filter(
        parts, lambda p: (p != "") & ~p.contains(":") & looks_machine_generated(p)
    )



"""Classification of indicators, scores and severities as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

#: Names an indicator's type may be given as.
TYPE_NAMES = {"hash": "hash", "md5": "hash", "sha1": "hash", "sha256": "hash", "ip": "ip", "ipv4": "ip", "ipv6": "ip", "domain": "domain", "host": "domain", "url": "url", "uri": "url", "email": "email"}


def is_hash(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]+$") & F.length(c).isin(32, 40, 64), F.lit(False))


def indicator_kind(c: Column) -> Column:
    n = F.length(c)
    return (
        F.when(c.rlike("^https?://"), "url").when(c.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(c.rlike("^[0-9a-fA-F]+$") & (n == 32), "md5").when(c.rlike("^[0-9a-fA-F]+$") & (n == 40), "sha1").when(c.rlike("^[0-9a-fA-F]+$") & (n == 64), "sha256")
        .when(F.contains(c, F.lit(".")), "domain").otherwise("unknown")
    )


def normal_type(c: Column) -> Column:
    low, out = F.lower(F.trim(c)), F.lower(F.trim(c))
    for k, v in TYPE_NAMES.items():
        out = F.when(low == k, v).otherwise(out)
    return out


def cvss_severity(score: Column) -> Column:
    return F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").otherwise("low")


def alert_case_severity(severity: Column) -> Column:
    return F.when(severity >= 10, "critical").when(severity >= 7, "high").otherwise("medium")


def hash_tokens(text: Column) -> Column:
    """The distinct blank-separated tokens of 32, 40 or 64 hexadecimal digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), is_hash))


def abuse_verdict(score: Column) -> Column:
    return F.when(score >= 50, "malicious").when(score >= 25, "suspicious").otherwise("clean")


def engine_verdict(malicious: Column, suspicious: Column, harmless: Column, undetected: Column) -> Column:
    """struct<total, verdict> from the counts of scan engines."""
    z = lambda c: F.coalesce(c, F.lit(0))
    total = z(malicious) + z(suspicious) + z(harmless) + z(undetected)
    verdict = F.when(z(malicious) > 0, "malicious").when(z(suspicious) > 0, "suspicious").when(total > 0, "clean").otherwise("unknown")
    return F.struct(total.alias("total"), verdict.alias("verdict"))


@pandas_udf(DoubleType())
def _entropy(texts: pd.Series) -> pd.Series:
    out = np.zeros(len(texts))
    for i, t in enumerate(texts):
        if t:
            _, n = np.unique(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
            p = n / n.sum()
            out[i] = -(p * np.log2(p)).sum()
    return pd.Series(out)


def text_entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits, over the whole text; empty and null are 0.

    Arrow batches with numpy: folding sorted characters in the JVM took ten times as long.
    """
    return _entropy(text)


def contains_any(text: Column, words: list[str]) -> Column:
    low, cond = F.lower(text), F.lit(False)
    for w in words:
        cond = cond | F.contains(low, F.lit(w.lower()))
    return F.coalesce(cond, F.lit(False))


#: Words of suspicious processes and paths, ports of remote control and of malware. One word of the first list
#: is in mixed case; here, as all names are compared in lower case, it matches as it is meant to.
PROCESS_WORDS = [
    "mimikatz", "powershell", "cmd.exe", "wscript", "cscript", "mshta", "rundll32", "regsvr32", "certutil", "bitsadmin",
    "net.exe", "net1.exe", "taskkill", "wmic", "schtasks", "vssadmin", "bcdedit", "wevtutil", "pnputil", "sc.exe",
    "wget.exe", "curl", "nc.exe", "ncat", "psexec", "procdump", "laZagne", "gsecdump", "mimikatz.exe", "xcopy",
    "robocopy", "reg", "lsass", "winlogon", "svchost",
]
PATH_WORDS = ["temp", "tmp", "appdata\\local\\temp", "\\temp\\", "\\tmp\\", "downloads", "desktop\\", "startup\\", "\\appdata\\roaming\\", "\\users\\public\\", "recycle.bin", "system32\\tasks\\", "programdata\\", "autostart"]
CONTROL_PORTS = [445, 139, 135, 3389, 22, 23]
MALWARE_PORTS = {
    "4444": "Metasploit default", "5555": "Android ADB / malware", "6666": "IRC bot / malware C2", "6667": "IRC bot / malware C2",
    "6668": "IRC bot / malware C2", "6669": "IRC bot / malware C2", "1337": "Common backdoor port", "2332": "GroupBusiness malware",
    "31337": "Back Orifice / Elite backdoor", "44344": "Cabinet malware",
}


def suspicious_process(name: Column) -> Column:
    return contains_any(name, PROCESS_WORDS)


def suspicious_path(path: Column) -> Column:
    return contains_any(path, PATH_WORDS)


def suspicious_port(port: Column) -> Column:
    return F.coalesce(port.isin(CONTROL_PORTS), F.lit(False))

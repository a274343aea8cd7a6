"""ATT&CK technique tables and tagging."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Technique id, name, tactic.
TECHNIQUES = [
    ("T1059", "Command and Scripting Interpreter", "Execution"),
    ("T1059.001", "PowerShell", "Execution"),
    ("T1059.003", "Windows Command Shell", "Execution"),
    ("T1204", "User Execution", "Execution"),
    ("T1547", "Boot or Logon Autostart Execution", "Persistence"),
    ("T1547.001", "Registry Run Keys / Startup Folder", "Persistence"),
    ("T1055", "Process Injection", "Privilege Escalation"),
    ("T1070", "Indicator Removal", "Defense Evasion"),
    ("T1027", "Obfuscated Files or Information", "Defense Evasion"),
    ("T1110", "Brute Force", "Credential Access"),
    ("T1555", "Credentials from Password Stores", "Credential Access"),
    ("T1539", "Steal Web Session Cookie", "Credential Access"),
    ("T1033", "System Owner/User Discovery", "Discovery"),
    ("T1082", "System Information Discovery", "Discovery"),
    ("T1087", "Account Discovery", "Discovery"),
    ("T1057", "Process Discovery", "Discovery"),
    ("T1049", "System Network Connections Discovery", "Discovery"),
    ("T1021", "Remote Services", "Lateral Movement"),
    ("T1005", "Data from Local System", "Collection"),
    ("T1185", "Browser Session Hijacking", "Collection"),
    ("T1043", "Commonly Used Port", "Command and Control"),
    ("T1071", "Application Layer Protocol", "Command and Control"),
    ("T1090", "Proxy", "Command and Control"),
    ("T1090.003", "Multi-hop Proxy / Tor", "Command and Control"),
    ("T1219", "Remote Access Software", "Command and Control"),
    ("T1041", "Exfiltration Over C2 Channel", "Exfiltration"),
    ("T1567", "Exfiltration Over Web Service", "Exfiltration"),
    ("T1486", "Data Encrypted for Impact", "Impact"),
    ("T1489", "Service Stop", "Impact"),
]

# Lower-case keyword and the technique it tags, in match order.
KEYWORDS = [
    ("powershell", "T1059.001"), ("-encodedcommand", "T1059.001"), ("-enc ", "T1059.001"),
    ("cmd.exe", "T1059.003"), ("whoami", "T1033"), ("net user", "T1087"),
    ("net localgroup", "T1087"), ("ipconfig", "T1082"), ("systeminfo", "T1082"),
    ("tasklist", "T1057"), ("netstat", "T1049"), ("mimikatz", "T1555"), ("lsass", "T1055"),
    ("currentversion\\run", "T1547.001"), ("runonce", "T1547.001"),
    ("startup folder", "T1547.001"), (".onion", "T1090.003"), ("tor", "T1090.003"),
    ("4444", "T1043"), ("1337", "T1043"), ("6667", "T1043"), ("8080", "T1043"),
    ("failed logon", "T1110"), ("brute", "T1110"), ("cookie", "T1539"), ("session", "T1185"),
    ("download", "T1005"), ("ransomware", "T1486"), ("encrypt", "T1486"), ("exfil", "T1041"),
    ("upload", "T1567"), ("rdp", "T1021"), ("winrm", "T1021"), ("wmic", "T1059.003"),
    ("wscript", "T1059"), ("cscript", "T1059"), ("regsvr32", "T1027"), ("certutil", "T1027"),
    ("bitsadmin", "T1071"), ("mshta", "T1059"), ("rundll32", "T1027"), ("schtasks", "T1547"),
    ("at.exe", "T1547"), ("sc.exe", "T1489"), ("net stop", "T1489"), ("vssadmin", "T1070"),
    ("bcdedit", "T1070"), ("wevtutil", "T1070"),
]

# Windows event id and the technique it tags.
EVENT_IDS = [
    (4625, "T1110"), (4688, "T1059"), (4697, "T1543"), (4698, "T1053"), (4702, "T1053"),
    (4720, "T1136"), (4726, "T1531"), (4732, "T1098"), (4657, "T1547.001"), (5039, "T1547.001"),
    (4663, "T1005"), (4660, "T1070"), (4776, "T1110"), (1102, "T1070"), (4104, "T1059.001"),
]

HIGH_RISK_TACTICS = ["Execution", "Credential Access", "Persistence", "Lateral Movement"]


def tag_text(text: Column, word_boundary: bool = False) -> Column:
    """Distinct technique ids whose keyword occurs in the text, in keyword order."""
    low = F.lower(text)

    def hit(word: str) -> Column:
        if not word_boundary:
            return low.contains(word)
        return low.rlike(r"(?<!\w)" + re.escape(word) + r"(?!\w)")

    return F.array_distinct(F.array_compact(F.array(*[F.when(hit(w), F.lit(t)) for w, t in KEYWORDS])))


def tag_event_id(col: Column) -> Column:
    found = F.lit(None).cast("string")
    for eid, tech in EVENT_IDS:
        found = F.when(col == eid, F.lit(tech)).otherwise(found)
    return F.array_compact(F.array(found))


def technique_table(spark: SparkSession) -> DataFrame:
    """The registry as a table: fixed size, safe to broadcast."""
    return spark.createDataFrame(
        [(t, n, ta, i) for i, (t, n, ta) in enumerate(TECHNIQUES)],
        "technique_id string, name string, tactic string, ord int",
    )


def with_technique_names(df: DataFrame, id_col: str = "technique_id") -> DataFrame:
    """Add name, tactic and url; unknown ids pass through with tactic Unknown."""
    reg = F.broadcast(
        technique_table(df.sparkSession).select(
            F.col("technique_id").alias("_tid"), F.col("name").alias("_n"), F.col("tactic").alias("_t")
        )
    )
    return (
        df.join(reg, F.col(id_col) == F.col("_tid"), "left")
        .withColumn("name", F.coalesce("_n", F.col(id_col)))
        .withColumn("tactic", F.coalesce("_t", F.lit("Unknown")))
        .withColumn(
            "url",
            F.concat(F.lit("https://attack.mitre.org/techniques/"), F.replace(F.col(id_col), F.lit("."), F.lit("/"))),
        )
        .drop("_tid", "_n", "_t")
    )

"""Rule sets of our own, made from their parameters, and rules converted from another layout.

A service rule is a service and an outcome: lines of the service that tell of the outcome. A cluster rule is a resource,
a verb or a tag of audit events.
"""

from __future__ import annotations

import re

from emberlog.operators.rules import Rule, seconds

#: Programs whose lines the service rules judge.
SERVICES = (
    "sshd sudo su login cron crond systemd kernel sysmon vpn exec disk nginx httpd postfix dovecot named dhcpd vsftpd proftpd smbd "
    "mysqld postgres redis mongod ldap kdc radiusd openvpn ipsec squid haproxy docker containerd kubelet etcd auditd iptables "
    "firewalld fail2ban snort zeek clamd rsyslogd ntpd chronyd backup agent"
).split()

#: name, what a line says (a regular expression), severity, technique
OUTCOMES = [
    ("denied", "(denied|refused|rejected)", 4, "T1110"),
    ("failed", "(failed|failure)", 3, "T1110"),
    ("invalid_user", "(invalid|unknown) user", 4, "T1087"),
    ("accepted", "(accepted|opened|logged in)", 1, "T1078"),
    ("crashed", "(segfault|core dumped|crash)", 4, "T1499"),
    ("restarted", "(restart|starting|started)", 1, ""),
    ("blocked", "(blocked|dropped|banned)", 3, "T1190"),
    ("full", "(no space|quota|is full)", 2, "T1499"),
    ("changed", "(modified|changed|updated)", 2, "T1565"),
    ("escalated", "(uid=0|as root|elevated)", 5, "T1548"),
]


def service_rules(services: list[str] | None = None) -> list[Rule]:
    """A rule for each service and outcome; failures also count in a window of two minutes."""
    out = []
    for s in services or SERVICES:
        for name, words, severity, technique in OUTCOMES:
            burst = {"window_s": 120, "threshold": 5} if name == "failed" else {}
            out.append(Rule(f"{s}_{name}".upper(), f"{s}: {name.replace('_', ' ')}", severity, technique, f"field:message ~= ^{s}.*{words}", **burst))
    return out


RESOURCES = [
    ("secrets", 4), ("pods/exec", 4), ("pods/attach", 4), ("pods/portforward", 3), ("serviceaccounts/token", 4), ("clusterroles", 3), ("clusterrolebindings", 5), ("roles", 2), ("rolebindings", 3),
    ("daemonsets", 3), ("deployments", 1), ("cronjobs", 2), ("configmaps", 1), ("networkpolicies", 3), ("validatingwebhookconfigurations", 4), ("mutatingwebhookconfigurations", 4), ("nodes", 2), ("namespaces", 2),
]
VERBS = [("impersonate", 5), ("delete", 2), ("deletecollection", 4), ("escalate", 5), ("bind", 4), ("patch", 1)]
BURSTS = [("k8s:unauthorized", 300, 10), ("k8s:secret-access", 60, 20), ("k8s:exec", 300, 5), ("k8s:delete", 60, 20), ("k8s:pod-create", 60, 50), ("k8s:rbac-change", 600, 3), ("k8s:impersonation", 600, 3)]


def cluster_rules() -> list[Rule]:
    """Rules over audit events: by resource, by verb, bursts of a tag, and by user, address and answer."""
    name = lambda x: re.sub(r"\W+", "_", x).upper()
    out = [Rule(f"CLUSTER_{name(r)}", f"Access to {r}", s, "T1613", f"field:k8s_resource == {r}") for r, s in RESOURCES]
    out += [Rule(f"CLUSTER_VERB_{name(v)}", f"Verb {v}", s, "T1098", f"field:verb == {v}") for v, s in VERBS]
    out += [Rule(f"CLUSTER_BURST_{name(t)}", f"Many events of {t}", 4, "T1613", f"tag:{t}", w, n) for t, w, n in BURSTS]
    out += [
        Rule("CLUSTER_ANONYMOUS", "Request of an anonymous user", 4, "T1078", "field:user == system:anonymous"),
        Rule("CLUSTER_SYSTEM_NAMESPACE", "Change in the system namespace", 3, "T1610", "field:namespace == kube-system"),
        Rule("CLUSTER_SERVER_ERROR", "Error of the server", 2, "", "field:response_code > 499"),
        Rule("CLUSTER_FORBIDDEN", "Forbidden", 2, "T1078", "field:response_code == 403"),
    ]
    return out


#: Playbooks for the techniques of converted rules.
PLAYBOOKS = {"T1110": "ip-reputation", "T1190": "ip-reputation", "T1204": "file-analysis", "T1566": "email-analysis", "T1059": "log-analysis", "T1547": "registry-check", "T1543": "file-analysis", "T1053": "file-analysis"}


def convert_rules(items: list[dict], prefix: str = "CONV", least_level: int = 3, window_s: int = 3600) -> list[Rule]:
    """Rules from dicts with id, level, match (a literal) or regex, decoded_as, frequency, timeframe, mitre (list), description, noalert.

    Left out are those below ``least_level``, without alert, or with neither match nor regex. A literal is searched in the
    message in any letter case, a regex as it is; a decoder's name takes precedence as a tag. A frequency becomes a
    threshold of at least 2, in ``window_s`` where no timeframe is given.
    """
    out = []
    for r in items:
        level = int(r.get("level") or 0)
        literal, regex = r.get("match") or "", r.get("regex") or ""
        if str(r.get("noalert", "")) == "1" or level < least_level or not (literal or regex):
            continue
        condition = f"tag:{r['decoded_as']}" if r.get("decoded_as") else "field:message ~= " + (literal if literal.startswith("^") else re.escape(literal).replace("\\ ", " ") if literal else regex)
        frequency = int(r.get("frequency") or 0)
        threshold = max(2, frequency) if frequency else 1
        window = seconds(f"{str(r['timeframe']).rstrip('s')}s") if r.get("timeframe") else window_s if frequency else 0
        techniques = [t.strip() for t in r.get("mitre") or []]
        book = next((PLAYBOOKS[t.split(".")[0]] for t in techniques if t.split(".")[0] in PLAYBOOKS), "full-enrich" if level >= 8 else "")
        out.append(Rule(f"{prefix}_{r['id']}", (r.get("description") or "").strip() or f"Rule {r['id']}", level, ",".join(techniques), condition, window, threshold, actions=((book, ()),) if book else ()))
    return out

"""The shipped detection rules and ATT&CK reference data.

Fixed values: conditions, parameters, patterns, mappings and explanation formats below must
be exactly these for detections to come out right.
"""

from __future__ import annotations


def _eq(**wanted: str) -> list[dict]:
    return [{"field": name, "op": "eq", "value": value} for name, value in wanted.items()]


def _logon(outcome: str, *more: dict) -> dict:
    return {
        "all": [
            *_eq(event_category="authentication", event_action="logon", event_outcome=outcome),
            *more,
        ]
    }


def _line(pattern: str) -> dict:
    return {"field": "command_line", "op": "matches", "value": pattern}


ROOT_SHELL = r"^(?:/usr)?(?:/s?bin/)?(?:su|bash|sh|zsh|dash|ksh)(?: -| -l| --login| -i)?$"
ENCODED_FLAG = (
    r"(?i)(?:^|\s)[-/–—―](?:e|ec|en[a-z]{0,12})(?:\s+|:)[A-Za-z0-9+/=]{16,}"
)
ENCODED_UTF16 = r"(?:[A-Za-z0-9+/][AQgw][AB][A-Za-z0-9+/]A[A-H][AEIMQUYcgkosw048]A){3,}"
PIPE_TO_SHELL = r"(?i)\b(?:curl|wget)\b[^|]{0,2048}\|\s*(?:sudo\s+)?(?:ba|z|da|k)?sh\b"
SHELL_OF_DOWNLOAD = r"(?i)\b(?:ba|z|da|k)?sh\b[^\n]{0,16}?(?:<\(|\$\()\s*(?:curl|wget)\b"
DOWNLOAD_THEN_SHELL = (
    r"(?i)\b(?:curl|wget)\b[^\n]{0,512}?(?:;|&&)\s*(?:sudo\s+)?(?:ba|z|da|k)?sh\s+[^\s;&|-]"
)
URLCACHE = r"(?i)[-/]urlcache\b"

RULES: list[dict] = [
    {
        "id": "ACCT-001",
        "name": "Privileged account created",
        "category": "account",
        "kind": "sequence",
        "severity": "high",
        "confidence": "high",
        "steps": [
            {"name": "created", "match": {"all": _eq(event_category="iam", event_action="user_created")}},
            {
                "name": "added",
                "match": {
                    "all": [
                        *_eq(event_category="iam", event_action="group_member_added"),
                        {
                            "field": "attributes.group_name",
                            "op": "in",
                            "value": ["sudo", "wheel", "admin", "administrators", "domain admins"],
                        },
                    ]
                },
            },
        ],
        "group_by": ["host", "target_account"],
        "threshold": 1,
        "time_window": "60m",
        "mitre": [
            ("T1136.001", "An account was created."),
            ("T1098.007", "The new account joined a privileged group."),
        ],
        "explanation": "A new account ($target_username) was created on $host and added to the "
        'privileged group "$attr_group_name" $gap later (at $last_seen).',
        "response": ["Disable the account if nobody authorized it.", "Review privileged groups on $host."],
    },
    {
        "id": "AUTH-001",
        "name": "Repeated SSH authentication failures",
        "category": "authentication",
        "kind": "threshold",
        "severity": "medium",
        "confidence": "medium",
        "match": _logon("failure", *_eq(service="sshd")),
        "group_by": ["source_ip", "host", "username"],
        "threshold": 5,
        "time_window": "5m",
        "mitre": [("T1110.001", "Repeated password attempts against one account from one source.")],
        "explanation": '$count failed SSH logons for "$username" on $host from $source_ip '
        "($source_ip_scope) within $span, between $first_seen and $last_seen. This rule alerts at "
        "$threshold failures within $time_window.",
        "response": ["Block $source_ip if it is not expected.", 'Use key-based logons for "$username".'],
    },
    {
        "id": "AUTH-002",
        "name": "Successful authentication after repeated failures",
        "category": "authentication",
        "kind": "sequence",
        "severity": "high",
        "confidence": "medium",
        "steps": [
            {"name": "failures", "match": _logon("failure")},
            {"name": "success", "match": _logon("success")},
        ],
        "group_by": ["source_ip", "username", "host"],
        "threshold": 3,
        "time_window": "10m",
        "max_gap": "5m",
        "mitre": [
            ("T1110", "The failures before the success."),
            ("T1078", "A working credential was used."),
        ],
        "explanation": '$failures_count failed logons for "$username" on $host from $source_ip '
        "($source_ip_scope), then a successful logon $gap after the last failure (at $last_seen). "
        "This rule alerts when at least $threshold failures precede a success within $time_window.",
        "response": ['Reset the credentials of "$username".', 'End open sessions of "$username" on $host.'],
    },
    {
        "id": "AUTH-003",
        "name": "One source attempting many accounts",
        "category": "authentication",
        "kind": "distinct",
        "severity": "medium",
        "confidence": "medium",
        "match": _logon("failure"),
        "group_by": ["source_ip"],
        "distinct_field": "username",
        "threshold": 5,
        "time_window": "10m",
        "mitre": [("T1110.003", "One source tries many accounts a few times each.")],
        "explanation": "$source_ip ($source_ip_scope) failed to log on as $distinct_count different "
        "accounts ($values_sample) within $span, on $host. This rule alerts at $threshold accounts "
        "within $time_window.",
        "response": ["Block $source_ip if it is not expected.", "Review lockout of the tried accounts."],
    },
    {
        "id": "AUTH-004",
        "name": "Logon from an unusual source",
        "category": "authentication",
        "kind": "new_value",
        "severity": "low",
        "confidence": "low",
        "match": _logon("success"),
        "group_by": ["username"],
        "value_field": "source_ip",
        "value_transform": "ip_network",
        "lookback": "14d",
        "min_history": 5,
        "mitre": [("T1078", "A valid credential used from somewhere new.")],
        "explanation": '"$username" logged on to $host from $source_ip ($value), a network not seen '
        "for this account in the previous $lookback ($history_count earlier successful logons from "
        "other networks).",
        "response": ['Ask the owner of "$username" about this logon.'],
    },
    {
        "id": "AUTH-005",
        "name": "One account attacked from many sources",
        "category": "authentication",
        "kind": "distinct",
        "severity": "medium",
        "confidence": "medium",
        "match": _logon("failure", {"field": "attributes.invalid_user", "op": "ne", "value": True}),
        "group_by": ["username"],
        "distinct_field": "source_ip",
        "threshold": 5,
        "time_window": "10m",
        "mitre": [("T1110.001", "Many attempts against one account from many addresses.")],
        "explanation": '"$username" failed to log on from $distinct_count different sources '
        "($values_sample) within $span, on $host. This rule alerts at $threshold sources within "
        "$time_window.",
        "response": ['Require multi-factor logons for "$username".'],
    },
    {
        "id": "NET-001",
        "name": "Connections to many ports or hosts",
        "category": "network",
        "kind": "distinct",
        "severity": "medium",
        "confidence": "medium",
        "match": {
            "all": _eq(event_category="network", event_action="connection", source_ip_scope="internal")
        },
        "group_by": ["source_ip"],
        "distinct_field": "destination",
        "threshold": 20,
        "time_window": "60s",
        "mitre": [("T1046", "Many connection attempts to different destinations.")],
        "explanation": "$source_ip ($host) connected to $distinct_count different destinations "
        "within $span (for example $values_sample). This rule alerts at $threshold destinations "
        "within $time_window.",
        "response": ["Isolate $host if the scan is not authorized."],
    },
    {
        "id": "PRIV-001",
        "name": "Suspicious privilege escalation indicator",
        "category": "privilege",
        "kind": "single",
        "severity": "medium",
        "confidence": "low",
        "match": {"all": _eq(event_category="privilege", event_action="sudo")},
        "indicators": [
            {
                "id": "not_in_sudoers",
                "name": "sudo attempted by a user without sudo rights",
                "confidence": "medium",
                "match": {
                    "all": [
                        *_eq(event_outcome="failure"),
                        {"field": "attributes.failure_reason", "op": "eq", "value": "not_in_sudoers"},
                    ]
                },
                "mitre": [("T1548.003", "sudo was tried without permission.")],
            },
            {
                "id": "root_shell",
                "name": "Interactive root shell through sudo",
                "match": {"all": [*_eq(event_outcome="success", target_username="root"), _line(ROOT_SHELL)]},
                "mitre": [("T1548.003", "sudo opened an unrestricted root shell.")],
            },
        ],
        "group_by": ["host", "username"],
        "mitre": [],
        "explanation": '$indicator_name: "$username" on $host ran "$command_line" as '
        "$target_username at $first_seen.",
        "response": ["Contain $host if this was not authorized.", "Review the sudoers file of $host."],
    },
    {
        "id": "PROC-001",
        "name": "Suspicious command line",
        "category": "process",
        "kind": "single",
        "severity": "high",
        "confidence": "medium",
        "match": {
            "all": [*_eq(event_category="process"), {"field": "command_line", "op": "exists"}]
        },
        "indicators": [
            {
                "id": "encoded_powershell",
                "name": "Encoded PowerShell command",
                "match": {
                    "any": [
                        {
                            "all": [
                                {
                                    "field": "process_name",
                                    "op": "in",
                                    "value": ["powershell.exe", "pwsh.exe", "pwsh"],
                                },
                                _line(ENCODED_FLAG),
                            ]
                        },
                        _line(ENCODED_UTF16),
                    ]
                },
                "mitre": [
                    ("T1059.001", "PowerShell was given an encoded command."),
                    ("T1027.010", "The encoding hides what the command does."),
                ],
            },
            {
                "id": "download_pipe_shell",
                "name": "Downloaded content run by a shell",
                "match": {
                    "any": [_line(PIPE_TO_SHELL), _line(SHELL_OF_DOWNLOAD), _line(DOWNLOAD_THEN_SHELL)]
                },
                "mitre": [
                    ("T1105", "Content is downloaded onto the host."),
                    ("T1059.004", "A Unix shell runs what was downloaded."),
                ],
            },
            {
                "id": "certutil_download",
                "name": "certutil used to download a file",
                "match": {"all": [*_eq(process_name="certutil.exe"), _line(URLCACHE)]},
                "mitre": [("T1105", "certutil downloads a file.")],
            },
            {
                "id": "dev_tcp_shell",
                "name": "Shell redirected over a network socket",
                "match": {"field": "command_line", "op": "contains", "value": "/dev/tcp/"},
                "mitre": [("T1059.004", "A shell is tied to a network connection.")],
            },
        ],
        "group_by": ["host"],
        "mitre": [],
        "explanation": '$indicator_name on $host: "$process_name" was started by "$username" at '
        '$first_seen with the command line "$command_line".',
        "response": ["Isolate $host unless this is a known task."],
    },
]

TACTICS = [
    "Reconnaissance", "Resource Development", "Initial Access", "Execution", "Persistence",
    "Privilege Escalation", "Stealth", "Defense Impairment", "Credential Access", "Discovery",
    "Lateral Movement", "Collection", "Command and Control", "Exfiltration", "Impact",
]
ATTACK_VERSION = "19.2"
TECHNIQUES = [
    ("T1110", "Brute Force", ["Credential Access"]),
    ("T1110.001", "Brute Force: Password Guessing", ["Credential Access"]),
    ("T1110.003", "Brute Force: Password Spraying", ["Credential Access"]),
    ("T1078", "Valid Accounts", ["Stealth", "Persistence", "Privilege Escalation", "Initial Access"]),
    (
        "T1548.003",
        "Abuse Elevation Control Mechanism: Sudo and Sudo Caching",
        ["Privilege Escalation"],
    ),
    ("T1136.001", "Create Account: Local Account", ["Persistence"]),
    (
        "T1098.007",
        "Account Manipulation: Additional Local or Domain Groups",
        ["Persistence", "Privilege Escalation"],
    ),
    ("T1059.001", "Command and Scripting Interpreter: PowerShell", ["Execution"]),
    ("T1059.004", "Command and Scripting Interpreter: Unix Shell", ["Execution"]),
    ("T1027.010", "Obfuscated Files or Information: Command Obfuscation", ["Stealth"]),
    ("T1105", "Ingress Tool Transfer", ["Command and Control"]),
    ("T1046", "Network Service Discovery", ["Discovery"]),
]
RULES_BY_ID = {rule["id"]: rule for rule in RULES}


def tuned(rule: dict | str, **changes) -> dict:
    """A rule with other numbers, exclusions or switches (`enabled`)."""
    rule = RULES_BY_ID[rule] if isinstance(rule, str) else rule
    return {**rule, **changes}


def mappings(rules: list[dict]) -> list[tuple[str, str, str, str]]:
    """(rule, indicator or "", technique, reason) of every mapping."""
    rows = [(r["id"], "", t, why) for r in rules for t, why in r["mitre"]]
    rows += [
        (r["id"], i["id"], t, why) for r in rules for i in r.get("indicators", []) for t, why in i["mitre"]
    ]
    return rows

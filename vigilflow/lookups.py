"""Fixed values of the domain: names, labels, groups, severities, VLANs, ports.

Everything here is data.  The tables are tiny and of constant size, so they
enter plans as literal maps (no join, no broadcast that could grow).
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# Metadata column keywords (matched anywhere in the lower-cased
# column name) that must never become features.
LEAKAGE_KEYWORDS = (
    "ip", "port", "timestamp", "flow id", "external ip", "unnamed",
    "simillarhttp", "inbound",
)

# Abbreviated flow-meter column names -> canonical names.
COLUMN_RENAMES = {
    "Tot Fwd Pkts": "Total Fwd Packets",
    "Tot Bwd Pkts": "Total Backward Packets",
    "TotLen Fwd Pkts": "Total Length of Fwd Packets",
    "TotLen Bwd Pkts": "Total Length of Bwd Packets",
    "Fwd Pkt Len Max": "Fwd Packet Length Max",
    "Fwd Pkt Len Min": "Fwd Packet Length Min",
    "Fwd Pkt Len Mean": "Fwd Packet Length Mean",
    "Fwd Pkt Len Std": "Fwd Packet Length Std",
    "Bwd Pkt Len Max": "Bwd Packet Length Max",
    "Bwd Pkt Len Min": "Bwd Packet Length Min",
    "Bwd Pkt Len Mean": "Bwd Packet Length Mean",
    "Bwd Pkt Len Std": "Bwd Packet Length Std",
    "Flow Byts/s": "Flow Bytes/s",
    "Flow Pkts/s": "Flow Packets/s",
    "Fwd IAT Tot": "Fwd IAT Total",
    "Bwd IAT Tot": "Bwd IAT Total",
    "Fwd Header Len": "Fwd Header Length",
    "Bwd Header Len": "Bwd Header Length",
    "Fwd Pkts/s": "Fwd Packets/s",
    "Bwd Pkts/s": "Bwd Packets/s",
    "Pkt Len Min": "Min Packet Length",
    "Pkt Len Max": "Max Packet Length",
    "Pkt Len Mean": "Packet Length Mean",
    "Pkt Len Std": "Packet Length Std",
    "Pkt Len Var": "Packet Length Variance",
    "FIN Flag Cnt": "FIN Flag Count",
    "SYN Flag Cnt": "SYN Flag Count",
    "RST Flag Cnt": "RST Flag Count",
    "PSH Flag Cnt": "PSH Flag Count",
    "ACK Flag Cnt": "ACK Flag Count",
    "URG Flag Cnt": "URG Flag Count",
    "ECE Flag Cnt": "ECE Flag Count",
    "Pkt Size Avg": "Average Packet Size",
    "Fwd Seg Size Avg": "Avg Fwd Segment Size",
    "Bwd Seg Size Avg": "Avg Bwd Segment Size",
    "Fwd Byts/b Avg": "Fwd Avg Bytes/Bulk",
    "Fwd Pkts/b Avg": "Fwd Avg Packets/Bulk",
    "Fwd Blk Rate Avg": "Fwd Avg Bulk Rate",
    "Bwd Byts/b Avg": "Bwd Avg Bytes/Bulk",
    "Bwd Pkts/b Avg": "Bwd Avg Packets/Bulk",
    "Bwd Blk Rate Avg": "Bwd Avg Bulk Rate",
    "Subflow Fwd Pkts": "Subflow Fwd Packets",
    "Subflow Fwd Byts": "Subflow Fwd Bytes",
    "Subflow Bwd Pkts": "Subflow Bwd Packets",
    "Subflow Bwd Byts": "Subflow Bwd Bytes",
    "Init Fwd Win Byts": "Init_Win_bytes_forward",
    "Init Bwd Win Byts": "Init_Win_bytes_backward",
    "Fwd Act Data Pkts": "act_data_pkt_fwd",
    "Fwd Seg Size Min": "min_seg_size_forward",
    "Dst Port": "Destination Port",
}

# Raw dataset labels -> unified labels.  The three web-attack
# labels also occur with an en dash, with its single byte, and with the two
# ways the byte was mangled.
LABEL_MERGE = {
    "Benign": "BENIGN",
    "Infilteration": "Infiltration",
    "DoS attacks-Hulk": "DoS Hulk",
    "DoS attacks-GoldenEye": "DoS GoldenEye",
    "DoS attacks-Slowloris": "DoS Slow",
    "DoS attacks-SlowHTTPTest": "DoS Slow",
    "DoS slowloris": "DoS Slow",
    "DoS Slowhttptest": "DoS Slow",
    "FTP-BruteForce": "FTP-Patator",
    "SSH-Bruteforce": "SSH-Patator",
    "DDoS attacks-LOIC-HTTP": "DDoS",
    "DDOS attack-HOIC": "DDoS",
    "DDOS attack-LOIC-UDP": "DDoS",
    "Brute Force -Web": "Web Attack - Brute Force",
    "Brute Force -XSS": "Web Attack - XSS",
    "SQL Injection": "Web Attack - Sql Injection",
    "Web Attack – Brute Force": "Web Attack - Brute Force",
    "Web Attack – XSS": "Web Attack - XSS",
    "Web Attack – Sql Injection": "Web Attack - Sql Injection",
    "Web Attack \xff\xbf\xbd Brute Force": "Web Attack - Brute Force",
    "Web Attack \xff\xbf\xbd XSS": "Web Attack - XSS",
    "Web Attack \xff\xbf\xbd Sql Injection": "Web Attack - Sql Injection",
    "Web Attack \xef\xbf\xbd Brute Force": "Web Attack - Brute Force",
    "Web Attack \xef\xbf\xbd XSS": "Web Attack - XSS",
    "Web Attack \xef\xbf\xbd Sql Injection": "Web Attack - Sql Injection",
    "Web Attack \x96 Brute Force": "Web Attack - Brute Force",
    "Web Attack \x96 XSS": "Web Attack - XSS",
    "Web Attack \x96 Sql Injection": "Web Attack - Sql Injection",
    "DrDoS_DNS": "DDoS Amplification",
    "DrDoS_LDAP": "DDoS Amplification",
    "DrDoS_MSSQL": "DDoS Amplification",
    "DrDoS_NetBIOS": "DDoS Amplification",
    "DrDoS_NTP": "DDoS Amplification",
    "DrDoS_SNMP": "DDoS Amplification",
    "DrDoS_SSDP": "DDoS Amplification",
    "TFTP": "DDoS Amplification",
    "Portmap": "DDoS Amplification",
    "LDAP": "DDoS Amplification",
    "MSSQL": "DDoS Amplification",
    "NetBIOS": "DDoS Amplification",
    "NTP": "DDoS Amplification",
    "SNMP": "DDoS Amplification",
    "SSDP": "DDoS Amplification",
    "DNS": "DDoS Amplification",
    "Syn": "DDoS SYN Flood",
    "DrDoS_UDP": "DDoS UDP Flood",
    "UDP-lag": "DDoS UDP Flood",
    "UDPLag": "DDoS UDP Flood",
    "UDP": "DDoS UDP Flood",
}

# The two flood classes that merge for the 11-class taxonomy.
FLOOD_MERGE = {
    "DDoS SYN Flood": "DDoS Volumetric",
    "DDoS UDP Flood": "DDoS Volumetric",
}

# Level-1 groups and their member classes (11 classes).
GROUP_MEMBERS = {
    "BENIGN": ["BENIGN"],
    "DDoS-family": ["DDoS", "DDoS Amplification", "DDoS Volumetric"],
    "DoS-family": ["DoS Hulk", "DoS GoldenEye", "DoS Slow"],
    "Brute-force": ["FTP-Patator", "SSH-Patator"],
    "PortScan": ["PortScan"],
    "Bot": ["Bot"],
}

# The same groups before the flood merge (12 classes).
GROUP_MEMBERS_12 = {
    **GROUP_MEMBERS,
    "DDoS-family": ["DDoS", "DDoS Amplification", "DDoS SYN Flood", "DDoS UDP Flood"],
}


def members_to_groups(groups: dict[str, list[str]]) -> dict[str, str]:
    """Turn ``group -> classes`` into ``class -> group``."""
    return {cls: group for group, classes in groups.items() for cls in classes}


CLASS_TO_GROUP = members_to_groups(GROUP_MEMBERS)
CLASS_TO_GROUP_12 = members_to_groups(GROUP_MEMBERS_12)
TARGET_CLASSES = sorted(CLASS_TO_GROUP)
BENIGN = "BENIGN"

# Severity of each class; any other label counts as "medium".
SEVERITY = {
    "BENIGN": "info",
    "DDoS": "critical",
    "DoS GoldenEye": "critical",
    "DoS Hulk": "critical",
    "DoS Slow": "critical",
    "PortScan": "medium",
    "Bot": "high",
    "FTP-Patator": "medium",
    "SSH-Patator": "medium",
    "DDoS Amplification": "critical",
    "DDoS SYN Flood": "critical",
    "DDoS UDP Flood": "critical",
    "DDoS Volumetric": "critical",
}
DEFAULT_SEVERITY = "medium"

# Severities in rising order; syslog severity numbers; the order
# used when result tables are sorted by severity.
SEVERITY_ORDER = ["info", "medium", "high", "critical"]
SYSLOG_SEVERITY = {"info": 6, "medium": 4, "high": 3, "critical": 2}
SYSLOG_FACILITY = 17
SEVERITY_SORT = {"critical": 0, "high": 1, "medium": 2, "info": 3}

# --------------------------------------------------------------------------
# VLAN plan.  Per-building VLANs are building * 100 + base.
BUILDINGS = (1, 2, 3, 4)
BUILDING_VLAN_NAMES = {
    10: "General-Users",
    11: "Finance",
    12: "HR",
    13: "IT-Admin",
    50: "VoIP",
    51: "Guest-WiFi",
    52: "IoT",
    99: "Management",
}
GLOBAL_VLAN_NAMES = {
    20: "App-Servers",
    21: "File-Servers",
    30: "Database",
    40: "Security-Systems",
    99: "OOB-Management",
    100: "RSPAN-IDS",
    60: "DMZ",
    61: "VPN-Pool",
    62: "VPN-Admin",
    999: "Blackhole",
}
# The console shows VLAN 40 under a shorter name and has no 99.
CONSOLE_VLAN_NAMES = {
    20: "App-Servers",
    21: "File-Servers",
    30: "Database",
    40: "Security",
    60: "DMZ",
    61: "VPN-Pool",
    62: "VPN-Admin",
    100: "RSPAN-IDS",
    999: "Blackhole",
}
GLOBAL_VLAN_BASES = (20, 21, 30, 40, 60, 61, 62, 100)


def per_building(*bases: int) -> list[int]:
    """VLAN ids of the given bases in every building."""
    return [building * 100 + base for base in bases for building in BUILDINGS]


VLAN_NAMES = {
    **{
        building * 100 + base: f"{name}-B{building}"
        for base, name in BUILDING_VLAN_NAMES.items()
        for building in BUILDINGS
    },
    **GLOBAL_VLAN_NAMES,
}
# VLAN sets of the severity and response rules.
CRITICAL_VLANS = sorted(per_building(51, 52, 99) + [30, 40, 99])
HIGH_VLANS = sorted(per_building(11, 12, 13) + [20, 21, 60])
MONITOR_VLANS = sorted(per_building(99) + [40, 99])

# Address ranges counted as internal, as (first octets, prefix).
INTERNAL_NETWORKS = ("10.0.0.0/8", "192.168.100.0/24", "172.16.0.0/12")

# Bases served by a building switch, and by the core switch.
ACCESS_SWITCH_BASES = (10, 11, 12, 13, 50, 51, 52)
CORE_SWITCH_BASES = (20, 21, 30, 40)
CORE_SWITCH_IP = "10.99.0.252"

# --------------------------------------------------------------------------
# Service names of well-known ports.
SERVICE_PORTS = {
    20: "FTP-Data", 21: "FTP", 22: "SSH", 23: "Telnet", 25: "SMTP",
    49: "TACACS", 53: "DNS", 67: "DHCP", 68: "DHCP", 69: "TFTP",
    80: "HTTP", 88: "Kerberos", 110: "POP3", 111: "RPC", 123: "NTP",
    135: "MS-RPC", 137: "NetBIOS", 138: "NetBIOS", 139: "NetBIOS",
    143: "IMAP", 161: "SNMP", 162: "SNMP-Trap", 179: "BGP", 389: "LDAP",
    443: "HTTPS", 445: "SMB", 465: "SMTPS", 514: "Syslog", 515: "LPD",
    587: "SMTP-Sub", 636: "LDAPS", 873: "rsync", 989: "FTPS", 990: "FTPS",
    993: "IMAPS", 995: "POP3S",
    1080: "SOCKS", 1433: "MSSQL", 1434: "MSSQL", 1521: "Oracle",
    1701: "L2TP", 1723: "PPTP", 1812: "RADIUS", 1813: "RADIUS-Acct",
    1900: "SSDP", 2049: "NFS", 2055: "NetFlow", 2082: "cPanel",
    3128: "HTTP-Proxy", 3268: "LDAP-GC", 3306: "MySQL", 3389: "RDP",
    3478: "STUN", 4444: "Metasploit", 5060: "SIP", 5061: "SIP-TLS",
    5222: "XMPP", 5353: "mDNS", 5432: "PostgreSQL", 5601: "Kibana",
    5900: "VNC", 5985: "WinRM", 5986: "WinRM-S", 6379: "Redis",
    6443: "k8s-API", 6667: "IRC", 8000: "HTTP-Alt", 8080: "HTTP-Proxy",
    8443: "HTTPS-Alt", 8888: "HTTP-Alt", 9000: "HTTP-Alt", 9090: "Prometheus",
    9100: "Node-Exp", 9200: "Elastic", 10000: "Webmin", 11211: "Memcached",
    27017: "MongoDB",
}

# Names of IP protocol numbers.
PROTOCOL_NAMES = {
    1: "ICMP", 2: "IGMP", 6: "TCP", 17: "UDP", 41: "IPv6",
    47: "GRE", 50: "ESP", 51: "AH", 58: "ICMPv6", 89: "OSPF", 112: "VRRP",
}

# Pseudo-regions of the threat map (name, latitude, longitude).
MAP_REGIONS = [
    ("China", 39.9, 116.4),
    ("Russia", 55.7, 37.6),
    ("USA", 38.9, -77.0),
    ("UK", 51.5, -0.1),
    ("France", 48.8, 2.3),
    ("Germany", 52.5, 13.4),
    ("Japan", 35.6, 139.7),
    ("Brazil", -23.5, -46.6),
    ("S. Korea", 37.5, 127.0),
    ("India", 28.6, 77.2),
]

# Switch message ids that raise a warning / count as notice.
SYSLOG_WARNING_IDS = (
    "PSECURE_VIOLATION",
    "IPACCESSLOGP",
    "IPACCESSLOGDP",
    "SSH_FAILED",
    "LOGIN_FAILED",
    "DHCP_SNOOPING_ERRMSG",
    "OSPF-5-ADJCHG",
    "OSPF_ADJCHG",
)
SYSLOG_INFO_IDS = ("UPDOWN", "CHANGED")

# Known trap OIDs and the ones that raise a warning.
TRAP_NAMES = {
    "1.3.6.1.6.3.1.1.5.1": "coldStart",
    "1.3.6.1.6.3.1.1.5.2": "warmStart",
    "1.3.6.1.6.3.1.1.5.3": "linkDown",
    "1.3.6.1.6.3.1.1.5.4": "linkUp",
    "1.3.6.1.6.3.1.1.5.5": "authenticationFailure",
    "1.3.6.1.6.3.1.1.5.6": "egpNeighborLoss",
    "1.3.6.1.4.1.9.9.315.0.0.1": "ciscoPortSecurityViolation",
    "1.3.6.1.4.1.9.9.41.2.0.1": "clogMessageGenerated",
}
TRAP_WARNINGS = ("authenticationFailure", "ciscoPortSecurityViolation", "linkDown")
TRAP_OID_MARK = "1.3.6.1.6.3.1.1.4.1"

# Flow-export field numbers used from templates.
EXPORT_FIELDS = {
    1: "IN_BYTES",
    2: "IN_PKTS",
    4: "PROTOCOL",
    6: "TCP_FLAGS",
    7: "L4_SRC_PORT",
    8: "IPV4_SRC_ADDR",
    11: "L4_DST_PORT",
    12: "IPV4_DST_ADDR",
    21: "LAST_SWITCHED",
    22: "FIRST_SWITCHED",
    23: "OUT_BYTES",
    24: "OUT_PKTS",
    58: "SRC_VLAN",
    59: "DST_VLAN",
    152: "FLOW_START_MS",
    153: "FLOW_END_MS",
}

# Trailing windows of the statistics queries.
WINDOWS = {"1h": "1 HOUR", "24h": "24 HOURS", "7d": "7 DAYS", "30d": "30 DAYS"}

# Interface abbreviations, first matching prefix wins.
INTERFACE_PREFIXES = [
    ("Gi", "GigabitEthernet"),
    ("Fa", "FastEthernet"),
    ("Te", "TenGigabitEthernet"),
    ("Po", "Port-channel"),
    ("Vl", "Vlan"),
    ("Et", "Ethernet"),
]

# Names of the 20 engineered features, in output order.
ENGINEERED_FEATURES = [
    "syn_flag_ratio", "ack_syn_ratio", "fin_flag_ratio", "psh_flag_ratio",
    "flag_diversity", "bytes_per_pkt_fwd", "bytes_per_pkt_bwd", "pkt_size_ratio",
    "fwd_bwd_pkt_ratio", "fwd_bwd_byte_ratio", "bwd_fwd_byte_ratio",
    "pkts_per_duration", "bytes_per_duration", "duration_log", "slow_indicator",
    "iat_cv", "fwd_pkt_len_cv", "rst_flag_ratio", "header_payload_ratio",
    "active_idle_ratio",
]

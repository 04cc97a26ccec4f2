"""Schemas of the JSON inputs (Spark DDL)."""

from __future__ import annotations

SENSOR_LINE = (
    "hostname STRING, output STRING, priority STRING, rule STRING, source STRING, "
    "tags ARRAY<STRING>, time STRING, output_fields MAP<STRING,STRING>"
)

_BINDINGS = "MAP<STRING,ARRAY<STRUCT<HostIp:STRING,HostPort:STRING>>>"

INSPECTION = (
    "Id STRING, Name STRING, Created STRING, RestartCount INT, Platform STRING, Image STRING, "
    "State STRUCT<Status:STRING,Running:BOOLEAN,Paused:BOOLEAN,Restarting:BOOLEAN,OOMKilled:BOOLEAN,"
    "Dead:BOOLEAN,Pid:BIGINT,ExitCode:INT,StartedAt:STRING,FinishedAt:STRING>, "
    "Config STRUCT<Image:STRING,Hostname:STRING,User:STRING,WorkingDir:STRING,Entrypoint:ARRAY<STRING>,"
    "Cmd:ARRAY<STRING>,Labels:MAP<STRING,STRING>,Env:ARRAY<STRING>,ExposedPorts:MAP<STRING,STRING>>, "
    "HostConfig STRUCT<Privileged:BOOLEAN,ReadonlyRootfs:BOOLEAN,NetworkMode:STRING,PidMode:STRING,"
    "IpcMode:STRING,UTSMode:STRING,UsernsMode:STRING,CapAdd:ARRAY<STRING>,CapDrop:ARRAY<STRING>,"
    "SecurityOpt:ARRAY<STRING>,Devices:ARRAY<STRUCT<PathInContainer:STRING,CgroupPermissions:STRING>>,"
    f"PortBindings:{_BINDINGS},Tmpfs:MAP<STRING,STRING>>, "
    f"NetworkSettings STRUCT<Ports:{_BINDINGS},Networks:MAP<STRING,STRUCT<NetworkID:STRING,"
    "EndpointID:STRING,Gateway:STRING,IPAddress:STRING,GlobalIPv6Address:STRING,Aliases:ARRAY<STRING>>>>, "
    "Mounts ARRAY<STRUCT<Type:STRING,Source:STRING,Destination:STRING,Mode:STRING,RW:BOOLEAN,"
    "Propagation:STRING>>, "
    "ImageDetails STRUCT<Id:STRING,RepoDigests:ARRAY<STRING>,RepoTags:ARRAY<STRING>,Os:STRING,"
    "Architecture:STRING,Created:STRING>"
)

LIFECYCLE_LINE = (
    "Type STRING, type STRING, Action STRING, action STRING, status STRING, scope STRING, "
    "Scope STRING, id STRING, time BIGINT, Time BIGINT, timeNano BIGINT, TimeNano BIGINT, "
    "Actor STRUCT<ID:STRING,Id:STRING,Attributes:MAP<STRING,STRING>,attributes:MAP<STRING,STRING>>, "
    "actor STRUCT<ID:STRING,Id:STRING,Attributes:MAP<STRING,STRING>,attributes:MAP<STRING,STRING>>"
)

SCAN_REPORT = (
    "Results ARRAY<STRUCT<Target:STRING,Class:STRING,Type:STRING,Vulnerabilities:ARRAY<STRUCT<"
    "VulnerabilityID:STRING,PkgName:STRING,PkgPath:STRING,InstalledVersion:STRING,FixedVersion:STRING,"
    "Status:STRING,Severity:STRING,SeveritySource:STRING,Title:STRING,Description:STRING,"
    "PrimaryURL:STRING,References:ARRAY<STRING>,"
    "CVSS:MAP<STRING,STRUCT<V2Score:STRING,V2Vector:STRING,V3Score:STRING,V3Vector:STRING>>>>>>"
)

SBOM = (
    "bomFormat STRING, specVersion STRING, serialNumber STRING, "
    "metadata STRUCT<timestamp:STRING>, components ARRAY<STRUCT<type:STRING,name:STRING,purl:STRING>>"
)

EPSS_FEED = "data ARRAY<STRUCT<cve:STRING,epss:STRING,percentile:STRING,date:STRING>>"

KEV_FEED = (
    "vulnerabilities ARRAY<STRUCT<cveID:STRING,dateAdded:STRING,dueDate:STRING,vendorProject:STRING,"
    "product:STRING,vulnerabilityName:STRING,requiredAction:STRING,knownRansomwareCampaignUse:STRING>>"
)

TRIAL = (
    "trial_id STRING, run_id STRING, container_id STRING, status STRING, failure_reason STRING, "
    "workload_id STRING, workload_family STRING, mode STRING, scenario_id STRING, "
    "hard_negative_id STRING, context_variant STRING, replica_index INT, human_tag STRING, "
    "image STRUCT<reference:STRING>, runtime_context_hash STRING, "
    "runtime_context STRUCT<privileged:BOOLEAN,capabilities:STRUCT<add:ARRAY<STRING>,drop:ARRAY<STRING>>,"
    "read_only_rootfs:BOOLEAN,network_mode:STRING,"
    "mounts:ARRAY<STRUCT<destination:STRING,type:STRING,read_only:BOOLEAN>>,"
    "devices:ARRAY<STRUCT<destination:STRING,permissions:STRING>>>, "
    "ground_truth STRUCT<attack_like:BOOLEAN,expected_outcome:STRING>, "
    "load STRUCT<operations_planned:BIGINT,successes:BIGINT,failures:BIGINT,"
    "latency_ms_samples:ARRAY<DOUBLE>>"
)

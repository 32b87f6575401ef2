"""Fact tables derived from the driver's tables.

Each fact table is one SELECT that Spark and DuckDB both accept: ``{name}`` stands for the table it reads (a plain
brace is doubled) and
``$SPREAD(n)`` for n copies of each row numbered by ``k``.  The Spark side runs it with ``spark.sql``; the oracle side
puts the same text into a WITH clause.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TABLES = """
region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations
""".split()

FACTS: dict[str, str] = {}

FACTS["fx_apps"] = """
SELECT s_suppkey AS app_id, 'com.app' || CAST(s_suppkey AS STRING) AS package,
  CASE WHEN s_acctbal < 0 THEN 'malware' ELSE 'benign' END AS corpus
FROM {supplier}"""

FACTS["fx_classes"] = """
SELECT p_partkey AS class_id,
  CASE WHEN p_partkey = 0 THEN NULL ELSE CAST(FLOOR((p_partkey - 1) / 3.0) AS BIGINT) END AS super_id,
  CASE WHEN p_partkey < 40 THEN 'android.view.C' WHEN p_partkey % 5 = 0 THEN 'com.google.C'
       WHEN p_partkey % 5 = 1 THEN 'com.inmobi.C' ELSE 'com.app.C' END || CAST(p_partkey AS STRING) AS class_name,
  p_size % 10 = 0 AS is_interface
FROM {part}"""

# Apps whose classes have equal names but different places in the hierarchy.
FACTS["fx_app_classes"] = """
SELECT p_partkey * 3 + k AS class_id, CAST(FLOOR(p_partkey / 1000.0) AS BIGINT) * 3 + k AS app_id, p_partkey % 1000 AS number,
  CASE WHEN p_partkey % 1000 = 0 THEN NULL ELSE (CAST(FLOOR(p_partkey / 1000.0) AS BIGINT) * 1000
    + CAST(FLOOR((p_partkey % 1000 - 1) / (2.0 + k)) AS BIGINT)) * 3 + k END AS super_id,
  'com.app.C' || CAST(p_partkey % 1000 AS STRING) AS class_name, 'm' || CAST((p_size + k) % 6 AS STRING) || ':()V' AS sub_sig
FROM {part} $SPREAD(3)"""

FACTS["fx_methods"] = """
SELECT p_partkey * 10 + k AS method_id, p_partkey AS class_id,
  'm' || CAST((p_size + k) % 12 AS STRING) || ':()V' AS sub_sig, k = 0 AS is_constructor,
  (p_partkey + k) % 9 = 0 AS is_static
FROM {part} $SPREAD(4)"""

FACTS["fx_components"] = """
SELECT p_partkey AS component_id, CAST(FLOOR(p_partkey / 20.0) AS BIGINT) AS app_id,
  'com.app.C' || CAST(p_partkey AS STRING) AS component,
  CASE p_size % 4 WHEN 0 THEN 'ACTIVITY' WHEN 1 THEN 'SERVICE' WHEN 2 THEN 'RECEIVER' ELSE 'PROVIDER' END AS comp_type,
  CASE p_size % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE NULL END AS exported_attr,
  CASE WHEN p_size % 7 = 0 THEN 'false' ELSE NULL END AS enabled_attr,
  CASE WHEN p_size % 5 = 0 THEN p_brand ELSE NULL END AS permission_attr
FROM {part}"""

FACTS["fx_filters"] = """
SELECT p_partkey AS filter_id, p_partkey AS component_id, 'act.' || p_type AS action, 'cat.' || p_brand AS category,
  CASE WHEN p_size % 4 = 0 THEN 'http' WHEN p_size % 4 = 2 THEN 'content' ELSE NULL END AS scheme,
  CASE WHEN p_size % 8 = 0 THEN 'h' || CAST(p_partkey % 3 AS STRING) ELSE NULL END AS host,
  CASE WHEN p_size % 16 = 0 THEN '/a' ELSE NULL END AS path_prefix,
  CASE p_size % 5 WHEN 0 THEN 'text/*' WHEN 1 THEN 'image/png' ELSE NULL END AS mime
FROM {part}
WHERE p_size % 2 = 0"""

FACTS["fx_intents"] = """
SELECT o_orderkey AS intent_id, CAST(FLOOR(o_custkey / 15.0) AS BIGINT) AS app_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'ACTIVITY' WHEN 1 THEN 'SERVICE' ELSE 'RECEIVER' END AS comp_type,
  CASE WHEN o_orderkey % 9 = 0 THEN 'com.app.C' || CAST(CAST(FLOOR(o_custkey / 15.0) AS BIGINT) * 20
       + o_orderkey % 20 AS STRING) ELSE NULL END AS component,
  CASE o_orderkey % 4 WHEN 0 THEN 'act.ECONOMY' WHEN 1 THEN 'act.SMALL' WHEN 2 THEN 'act.PROMO' ELSE NULL END AS action,
  CASE WHEN o_orderkey % 5 = 0 THEN 'cat.Brand#' || CAST(o_custkey % 25 + 1 AS STRING) ELSE NULL END AS category,
  CASE WHEN o_orderkey % 8 = 1 THEN 'http://h' || CAST(o_custkey % 3 AS STRING) || '/a/b'
       WHEN o_orderkey % 8 = 2 THEN 'content:x' ELSE NULL END AS uri,
  CASE WHEN o_orderkey % 6 = 1 THEN 'text/plain' WHEN o_orderkey % 6 = 2 THEN 'image/png' ELSE NULL END AS mime,
  o_orderkey % 11 <> 0 AS precise_explicit, o_orderkey % 13 <> 0 AS precise_implicit
FROM {orders}"""

# Graphs from all rows: each supplier has 120 nodes of its own, and every fourth supplier's nodes belong to one large
# app, which so grows with the data.  Edges lead some steps on, so closures take several rounds.
_APP = "CASE WHEN l_suppkey % 4 = 0 THEN 4 ELSE l_suppkey END"

# Filters and requests with several values of every kind, one row for each value; some filters take any action.
FACTS["fx_filter_values"] = """
SELECT CAST(FLOOR(l_partkey / 40.0) AS BIGINT) AS app_id, l_partkey AS filter_id, (l_orderkey + l_linenumber) % 7 AS kind,
  CASE (l_orderkey + l_linenumber) % 7
    WHEN 2 THEN 'c' || CAST(l_suppkey % 4 AS STRING)
    WHEN 3 THEN CASE l_suppkey % 3 WHEN 0 THEN 'http' WHEN 1 THEN 'content' ELSE 'x' END
    WHEN 4 THEN 'h' || CAST(l_suppkey % 3 AS STRING)
    WHEN 5 THEN CASE l_orderkey % 3 WHEN 0 THEN '/a' WHEN 1 THEN '/ab' ELSE CASE l_suppkey % 3 WHEN 0 THEN '/(a|b)+' WHEN 1 THEN '/((a)(b))+x' ELSE '/b.*' END END
    WHEN 6 THEN CASE l_suppkey % 4 WHEN 0 THEN 'text/*' WHEN 1 THEN 'image/png' WHEN 2 THEN 'audio/x' ELSE 'video/*' END
    ELSE CASE WHEN l_suppkey % 40 = 0 THEN 'ANY' ELSE 'a' || CAST(l_suppkey % 6 AS STRING) END END AS value,
  CASE WHEN l_orderkey % 4 = 1 THEN '80' WHEN l_orderkey % 4 = 2 THEN '81' END AS port, l_orderkey % 3 AS form
FROM {lineitem} WHERE l_partkey % 5 > 0 OR (l_orderkey + l_linenumber) % 7 < 3"""

FACTS["fx_request_values"] = """
SELECT CAST(FLOOR(o_custkey / 30.0) AS BIGINT) AS app_id, o_orderkey AS intent_id, (l_partkey + l_linenumber) % 5 AS kind,
  CASE (l_partkey + l_linenumber) % 5
    WHEN 2 THEN 'c' || CAST(l_suppkey % 5 AS STRING)
    WHEN 3 THEN CASE l_suppkey % 4 WHEN 0 THEN 'http' WHEN 1 THEN 'content' WHEN 2 THEN 'x' END
    WHEN 4 THEN CASE l_suppkey % 3 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'image/*' ELSE 'video/y' END
    ELSE 'a' || CAST(l_suppkey % 8 AS STRING) END AS value,
  CASE WHEN l_partkey % 4 > 0 THEN 'h' || CAST(l_partkey % 3 AS STRING) END AS host,
  CASE l_partkey % 3 WHEN 1 THEN '80' WHEN 2 THEN '81' END AS port,
  CASE l_suppkey % 6 WHEN 0 THEN '/a' WHEN 1 THEN '/abab' WHEN 2 THEN '/' || repeat('ab', 700) || 'x' WHEN 3 THEN '/bc' WHEN 4 THEN '/' || repeat('b', 1500) END AS path
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"""

# Calls on bundles and filters; ``other`` is the object that one is copied from.
FACTS["fx_object_calls"] = """
SELECT DISTINCT (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS site_id, l_suppkey AS app_id, (l_orderkey + l_linenumber) % 12 AS op, l_suppkey * 1000 + l_partkey % 90 AS object,
  l_suppkey * 1000 + (l_partkey % 90 * 7 + l_orderkey % 3) % 45 AS other, -((l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey) AS made,
  'k' || CAST(l_orderkey % 6 AS STRING) AS key, l_orderkey % 9 = 0 AS open_key, 'v' || CAST(l_orderkey % 4 AS STRING) AS text, l_orderkey % 7 = 0 AS open_text
FROM {lineitem}"""

FACTS["fx_call_edges"] = f"""
SELECT DISTINCT {_APP} AS app_id, l_suppkey * 120 + l_partkey % 120 AS caller,
  l_suppkey * 120 + (l_partkey % 120 + 1 + (l_orderkey + l_linenumber * 7) % 40) % 120 AS callee
FROM {{lineitem}}"""

FACTS["fx_dep_edges"] = f"""
SELECT DISTINCT {_APP} AS app_id, l_suppkey * 120 + l_partkey % 120 AS use_node,
  l_suppkey * 120 + (l_partkey % 120 + 3 + (l_orderkey * 3 + l_linenumber) % 50) % 120 AS def_node
FROM {{lineitem}}"""

FACTS["fx_call_sites"] = """
SELECT l_orderkey * 10 + l_linenumber AS site_id, l_suppkey AS app_id, l_partkey % 60 AS owner,
  CASE l_partkey % 6 WHEN 0 THEN 'Ljavax/crypto/Cipher;.getInstance:(Ljava/lang/String;)Ljavax/crypto/Cipher;'
    WHEN 1 THEN 'Lorg/apache/http/conn/ssl/SSLSocketFactory;.setHostnameVerifier:(Lorg/apache/http/conn/ssl/X509HostnameVerifier;)V'
    WHEN 2 THEN 'Landroid/content/pm/PackageManager;.setComponentEnabledSetting:(Landroid/content/ComponentName;II)V'
    WHEN 3 THEN 'Landroid/util/Log;.i:(Ljava/lang/String;Ljava/lang/String;)I'
    WHEN 4 THEN 'Landroid/app/Activity;.startActivity:(Landroid/content/Intent;)V'
    ELSE 'Landroid/app/Activity;.findViewById:(I)Landroid/view/View;' END AS callee_sig
FROM {lineitem}"""

FACTS["fx_arg_values"] = """
SELECT l_orderkey * 10 + l_linenumber AS site_id, l_suppkey AS app_id, k AS arg_idx,
  CASE WHEN (l_partkey + k) % 7 = 0 THEN 'point_string' WHEN k >= 2 THEN 'int' ELSE 'string' END AS kind,
  CASE WHEN (l_partkey + k) % 7 = 0 THEN NULL
    WHEN k = 0 THEN CASE l_linenumber % 3 WHEN 0 THEN 'AES' WHEN 1 THEN 'AES/CBC/PKCS5Padding'
                    ELSE 'DES/ECB/NoPadding' END
    WHEN k = 1 THEN CASE l_linenumber % 2
      WHEN 0 THEN '@@org.apache.http.conn.ssl.SSLSocketFactory.ALLOW_ALL_HOSTNAME_VERIFIER' ELSE 'strict' END
    ELSE CAST((l_linenumber + 4 - k) % 4 AS STRING) END AS value
FROM {lineitem} $SPREAD(4)"""

FACTS["fx_code"] = """
SELECT doc_id AS unit_id, doc_id % 10 AS app_id, 'com.app.C' || CAST(doc_id AS STRING) AS class_name, text AS code
FROM {documents}"""

FACTS["fx_permission_lines"] = """
SELECT CAST(FLOOR(event_id / 500.0) AS BIGINT) AS file_id, event_id AS line_no,
  CASE WHEN event_type = 'signup' THEN 'Permission:android.permission.P' || CAST(user_id % 20 AS STRING)
       WHEN event_type = 'error' THEN 'noise'
       ELSE '<android.app.C' || CAST(user_id % 30 AS STRING) || ': void m' || CAST(event_id % 50 AS STRING)
            || '(int,long)>  (x)' END AS line
FROM {events}"""

# Decompiled code with literals, platform calls and URLs, one text per order.
FACTS["fx_code_units"] = """
SELECT o_orderkey AS unit_id, CAST(FLOOR(o_custkey / 15.0) AS BIGINT) AS app_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'com.google.U' WHEN 1 THEN 'com.tapjoy.sdk.U' ELSE 'com.app.U' END
    || CAST(o_orderkey AS STRING) AS class_name,
  CASE WHEN o_orderkey % 4 < 2 THEN 'library' ELSE 'application' END AS origin,
  'const-string v0 "android.api.C' || CAST(o_custkey % 40 AS STRING) || '"' || chr(10)
    || 'const-string v1 "m' || CAST(o_orderkey % 12 AS STRING) || '"' || chr(10)
    || 'constclass @type ^`Landroid/api/C' || CAST(o_orderkey % 40 AS STRING) || ';` "' || chr(10)
    || CASE o_custkey % 9 WHEN 0 THEN 'call Ljava/lang/Class;.forName:(x)' WHEN 1 THEN 'NATIVE {{'
         WHEN 2 THEN 'call Lx;.loadClass:(Ljava/lang/String;)Ljava/lang/Class;' WHEN 3 THEN 'https://m.facebook.com/dialog'
         WHEN 4 THEN 'api.twitter.com/1' WHEN 5 THEN 'access_token=' WHEN 6 THEN 'Lcom/x/Facebook;.dialog:(x)'
         WHEN 7 THEN 'see http://h' || CAST(o_orderkey % 5 AS STRING) || '.github.com/a?b=c'
         ELSE 'startActivity:(Landroid/content/Intent;)V @classDescriptor startActivity:(Landroid/content/Intent;)V @classDescriptor' END
    AS code
FROM {orders}"""

FACTS["fx_api_list"] = """
SELECT DISTINCT CASE p_size % 2 WHEN 0 THEN 'hidden' ELSE 'nonpublic' END AS kind,
  'android.api.C' || CAST(p_partkey % 40 AS STRING) AS class_name, 'm' || CAST(p_size % 12 AS STRING) AS method
FROM {part}"""

FACTS["fx_taint_nodes"] = """
SELECT DISTINCT app_id, node, CASE WHEN node % 10 = 3 THEN 'source' ELSE 'sink' END AS role,
  CASE WHEN node % 10 = 3 THEN CASE CAST(FLOOR(node / 10.0) AS BIGINT) % 4 WHEN 0 THEN 'API_SOURCE' WHEN 1 THEN 'CALLBACK_SOURCE'
      WHEN 2 THEN 'ICC_SOURCE' ELSE 'STMT_SOURCE' END
    ELSE CASE CAST(FLOOR(node / 10.0) AS BIGINT) % 3 WHEN 0 THEN 'API_SINK' WHEN 1 THEN 'ICC_SINK' ELSE 'STMT_SINK' END END AS category,
  'd' || CAST(node AS STRING) AS descriptor
FROM (SELECT app_id, use_node AS node FROM {fx_dep_edges} UNION SELECT app_id, def_node FROM {fx_dep_edges}) n
WHERE node % 10 IN (3, 7)"""

FACTS["fx_strings"] = """
SELECT page_id % 100 AS app_id, 'resource' AS origin, 'open ' || url || ' now' AS value
FROM {pages}"""

FACTS["fx_page_urls"] = """
SELECT page_id % 100 AS app_id, url FROM {pages}"""

# findViewById calls and sensitive controls.
FACTS["fx_view_calls"] = """
SELECT l_orderkey * 10 + l_linenumber AS site_id, l_suppkey AS app_id,
  CASE l_linenumber % 3 WHEN 0 THEN 'Landroid/app/Activity;.findViewById:(I)Landroid/view/View;'
    WHEN 1 THEN 'Landroid/view/View;.findViewById:(I)Landroid/view/View;'
    ELSE 'Landroid/util/Log;.i:(Ljava/lang/String;Ljava/lang/String;)I' END AS callee_sig,
  1 AS arg_idx, CASE WHEN l_orderkey % 11 = 0 THEN 'point_string' ELSE 'int' END AS kind,
  CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE CAST(l_partkey % 40 AS STRING) END AS value
FROM {lineitem}"""

FACTS["fx_layout_attrs"] = """
SELECT CAST(FLOOR(p_partkey / 20.0) AS BIGINT) AS app_id, p_partkey % 20 AS control_id, 'android.widget.EditText' AS view_class,
  CASE WHEN k = 0 THEN 'android:id' WHEN p_size % 7 = k THEN 'android:password' ELSE 'android:inputType' END AS attr,
  CASE WHEN k = 0 THEN '@id/x' WHEN p_size % 7 = k THEN CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END
       WHEN p_size % 5 = k THEN 'textPassword' ELSE 'text' END AS value
FROM {part} $SPREAD(3)"""

# setContentView calls of a class, and layouts with includes and click handlers.  Each app uses the same layout ids.
FACTS["fx_layout_calls"] = """
SELECT o_orderkey AS site_id, o_custkey % 7 AS app_id, o_custkey AS class_id,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Lx/Y;.setTitle:(I)V' ELSE 'Lx/Y;.setContentView:(I)V' END AS callee_sig,
  1 AS arg_idx, CASE WHEN o_orderkey % 7 = 0 THEN 'point_string' ELSE 'int' END AS kind,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 50 AS STRING) END AS value
FROM {orders}"""

FACTS["fx_layout_includes"] = """
SELECT DISTINCT k AS app_id, p_size AS layout_id, (p_size + 1 + k) % 50 AS included_id FROM {part} $SPREAD(7) WHERE (p_size + k) % 5 = 0"""

FACTS["fx_layout_handlers"] = """
SELECT DISTINCT k AS app_id, p_size AS layout_id, 'm' || CAST((p_size + k) % 12 AS STRING) AS method_name FROM {part} $SPREAD(7)"""

# A hierarchy with listener interfaces, declared methods and calls that register listeners.
FACTS["fx_listener_classes"] = """
SELECT p_partkey AS class_id, CASE WHEN p_partkey >= 8 THEN p_partkey % 3 ELSE NULL END AS app_id,
  CASE WHEN p_partkey < 8 OR p_partkey % 50 = 0 THEN NULL ELSE CAST(FLOOR((p_partkey - 1) / 3.0) AS BIGINT) END AS super_id,
  CASE WHEN p_partkey >= 8 AND p_size % 6 = 0 THEN CAST(p_partkey % 5 AS BIGINT) ELSE NULL END AS interface_id,
  CASE p_partkey WHEN 0 THEN 'android.view.View$OnClickListener' WHEN 1 THEN 'android.location.LocationListener'
    WHEN 2 THEN 'android.webkit.WebViewClient' WHEN 3 THEN 'android.view.View$OnKeyListener'
    WHEN 4 THEN 'android.os.IBinder$DeathRecipient' WHEN 5 THEN 'android.app.Activity' WHEN 6 THEN 'android.app.Service'
    WHEN 7 THEN 'android.content.BroadcastReceiver' ELSE 'com.app.C' || CAST(p_partkey AS STRING) END AS class_name,
  p_partkey IN (0, 1, 3, 4) AS is_interface, p_size % 11 <> 0 AS is_concrete
FROM {part}"""

FACTS["fx_listener_methods"] = """
SELECT p_partkey AS class_id,
  CASE WHEN p_partkey IN (5, 6, 7) THEN
    CASE k WHEN 0 THEN 'onCreate:(Landroid/os/Bundle;)V' WHEN 1 THEN 'onStart:(Landroid/content/Intent;I)V' ELSE 'onClick:(Landroid/view/View;)V' END
  ELSE CASE (p_size + k) % 4 WHEN 0 THEN 'onCreate:(Landroid/os/Bundle;)V' WHEN 1 THEN 'onStart:(Landroid/content/Intent;I)V'
    WHEN 2 THEN 'onClick:(Landroid/view/View;)V' ELSE 'onKey:(I)Z' END END AS sub_sig,
  (p_partkey + k) % 9 = 0 AS is_static
FROM {part} $SPREAD(3)"""

FACTS["fx_listener_calls"] = """
SELECT DISTINCT (o_custkey + 8) % 3 AS app_id, o_custkey % 8 + 100 AS component_id, o_custkey + 8 AS owner_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'Lx/B;.setOnClickListener:(Landroid/view/View$OnClickListener;)V'
    WHEN 1 THEN 'Lx/L;.listen:(ILandroid/location/LocationListener;)V'
    WHEN 2 THEN 'Lx/W;.client:([Landroid/webkit/WebViewClient;)V' ELSE 'Lx/N;.none:(Ljava/lang/String;)V' END AS callee_sig
FROM {orders}"""

# Intent-building calls: which instance, which attribute, resolved or not.
FACTS["fx_intent_calls"] = """
SELECT l_orderkey * 10 + l_linenumber AS site_id, l_suppkey AS app_id, l_orderkey AS instance_id,
  'Landroid/content/Intent;.' || CASE l_linenumber % 7
    WHEN 0 THEN '<init>:(Landroid/content/Context;Ljava/lang/Class;)V'
    WHEN 1 THEN 'setAction:(Ljava/lang/String;)Landroid/content/Intent;'
    WHEN 2 THEN 'addCategory:(Ljava/lang/String;)Landroid/content/Intent;'
    WHEN 3 THEN 'setDataAndType:(Landroid/net/Uri;Ljava/lang/String;)Landroid/content/Intent;'
    WHEN 4 THEN 'setComponent:(Landroid/content/ComponentName;)Landroid/content/Intent;'
    WHEN 5 THEN 'setType:(Ljava/lang/String;)Landroid/content/Intent;'
    ELSE 'addFlags:(I)Landroid/content/Intent;' END AS callee_sig,
  'val.' || CAST(l_partkey % 30 AS STRING) AS text_value, l_partkey % 8 = 0 AS unresolved,
  l_partkey % 200 AS helper_id
FROM {lineitem}"""

FACTS["fx_helper_calls"] = """
SELECT p_partkey AS site_id, CAST(FLOOR(p_partkey / 20.0) AS BIGINT) AS app_id, p_partkey % 200 AS instance_id,
  CASE p_size % 3 WHEN 0 THEN 'Landroid/net/Uri;.parse:(Ljava/lang/String;)Landroid/net/Uri;'
    WHEN 1 THEN 'Landroid/content/ComponentName;.<init>:(Landroid/content/Context;Ljava/lang/String;)V'
    ELSE 'Landroid/content/ComponentName;.<init>:(Landroid/content/Context;Ljava/lang/Class;)V' END AS callee_sig,
  CASE p_size % 3 WHEN 0 THEN 'http://h' || CAST(p_size AS STRING) || '/p' ELSE 'com.app.C' || CAST(p_partkey AS STRING) END AS text_value,
  p_size % 9 = 0 AS unresolved
FROM {part}"""

# Bundle writes and reads: rows with odd and even line numbers.  Bundles are as many as the app has parts.
FACTS["fx_puts"] = """
SELECT l_suppkey AS app_id, l_partkey AS instance_id,
  CASE WHEN l_partkey % 13 = 0 THEN 'point_string' ELSE 'string' END AS key_kind,
  CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE 'k' || CAST(l_orderkey % 6 AS STRING) END AS key,
  l_orderkey * 10 + l_linenumber AS value_id
FROM {lineitem}
WHERE l_linenumber % 2 = 1"""

FACTS["fx_gets"] = """
SELECT l_orderkey * 10 + l_linenumber AS get_id, l_suppkey AS app_id, l_partkey AS instance_id,
  CASE WHEN l_partkey % 17 = 0 THEN 'point_string' ELSE 'string' END AS key_kind,
  CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE 'k' || CAST(l_orderkey % 6 AS STRING) END AS key,
  CASE WHEN l_orderkey % 2 = 0 THEN -l_orderkey ELSE NULL END AS default_id
FROM {lineitem}
WHERE l_linenumber % 2 = 0"""

# Receivers registered at run time.
FACTS["fx_register_calls"] = """
SELECT o_orderkey AS site_id, CAST(FLOOR(o_custkey / 15.0) AS BIGINT) AS app_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Lx/C;.registerReceiver:(Landroid/content/BroadcastReceiver;Landroid/content/IntentFilter;)Landroid/content/Intent;'
       ELSE 'Lx/C;.registerReceiver:(Landroid/content/BroadcastReceiver;Landroid/content/IntentFilter;Ljava/lang/String;Landroid/os/Handler;)Landroid/content/Intent;' END AS callee_sig,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 'com.app.R' || CAST(o_custkey % 15 AS STRING) END AS receiver_type,
  o_custkey % 40 AS filter_instance,
  CASE WHEN o_orderkey % 6 = 1 THEN 'perm.P' || CAST(o_custkey % 4 AS STRING) ELSE NULL END AS permission
FROM {orders}"""

FACTS["fx_filter_fields"] = """
SELECT DISTINCT CAST(FLOOR(p_partkey / 20.0) AS BIGINT) AS app_id, p_partkey % 40 AS filter_instance,
  CASE k WHEN 0 THEN 'action' ELSE 'category' END AS field,
  CASE WHEN p_size % 8 = k THEN 'point_string' ELSE 'string' END AS kind,
  CASE WHEN p_size % 8 = k THEN NULL ELSE 'f.' || p_brand END AS value
FROM {part} $SPREAD(2)"""

# Points-to facts: each row is an allocation, a copy, a field store or a load, by its line number.  Copies lead to later
# variables, so that sets stay of moderate size.
_VAR = "l_suppkey * 1500 + (l_partkey * 7 + l_orderkey) % 1500"
_OTHER = "l_suppkey * 1500 + ((l_partkey * 7 + l_orderkey) % 1500 + 1 + l_orderkey % 5) % 1500"
FACTS["fx_alloc"] = f"""
SELECT DISTINCT l_suppkey AS app_id, {_VAR} AS var, l_suppkey * 50 + l_orderkey % 50 AS instance_id
FROM {{lineitem}} WHERE l_linenumber % 4 = 0"""
FACTS["fx_assign"] = f"""
SELECT DISTINCT l_suppkey AS app_id, LEAST({_VAR}, {_OTHER}) AS src, GREATEST({_VAR}, {_OTHER}) AS dst
FROM {{lineitem}} WHERE l_linenumber % 4 = 1"""
FACTS["fx_store"] = f"""
SELECT DISTINCT l_suppkey AS app_id, {_VAR} AS base, 'f' || CAST(l_orderkey % 7 AS STRING) AS field, {_OTHER} AS src
FROM {{lineitem}} WHERE l_linenumber % 4 = 2"""
FACTS["fx_load"] = f"""
SELECT DISTINCT l_suppkey AS app_id, {_VAR} AS base, 'f' || CAST(l_orderkey % 7 AS STRING) AS field, {_OTHER} AS dst
FROM {{lineitem}} WHERE l_linenumber % 4 = 3"""

FACTS["fx_services"] = """
SELECT o_orderkey AS site_id, CAST(FLOOR(o_custkey / 15.0) AS BIGINT) AS app_id,
  'Landroid/content/Context;.getSystemService:(Ljava/lang/String;)Ljava/lang/Object;' AS callee_sig,
  1 AS arg_idx, CASE WHEN o_orderkey % 7 = 0 THEN 'point_string' ELSE 'string' END AS kind,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CASE o_custkey % 4 WHEN 0 THEN 'phone' WHEN 1 THEN 'wifi' WHEN 2 THEN 'location'
    ELSE 'nosuch' END END AS value
FROM {orders}"""

# Framework and SDK methods with visibility.
FACTS["fx_framework"] = """
SELECT p_partkey * 10 + k AS method_id,
  CASE WHEN p_partkey % 3 = 0 THEN 'android.os.C' WHEN p_partkey % 3 = 1 THEN 'com.android.C' ELSE 'org.x.C' END
    || CAST(p_partkey AS STRING) AS class_name,
  'm' || CAST((p_size + k) % 12 AS STRING) AS method, k <> 1 OR p_size % 2 = 0 AS is_public, p_size % 9 = 0 AS is_abstract,
  k = 0 AS is_constructor
FROM {part} $SPREAD(4)"""

FACTS["fx_sdk"] = """
SELECT CASE WHEN p_partkey % 3 = 0 THEN 'android.os.C' ELSE 'com.android.C' END || CAST(p_partkey AS STRING) AS class_name,
  'm' || CAST((p_size + 2) % 12 AS STRING) AS method
FROM {part} WHERE p_size % 4 <> 0 AND p_partkey % 3 <> 2"""

# Dependence-graph nodes with what they stand for.
FACTS["fx_nodes"] = f"""
SELECT DISTINCT {_APP} AS app_id, l_suppkey * 120 + l_partkey % 120 AS node,
  CAST(FLOOR((l_suppkey * 120 + l_partkey % 120) / 5.0) AS BIGINT) AS site_id,
  CASE l_partkey % 5 WHEN 0 THEN 'virtual_body' WHEN 1 THEN 'call_arg' WHEN 2 THEN 'call_arg' WHEN 3 THEN 'entry_param'
    ELSE 'normal' END AS node_kind,
  CASE l_partkey % 5 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN l_partkey % 3 ELSE NULL END AS position,
  CASE WHEN l_partkey % 5 < 3 THEN CASE CAST(FLOOR((l_partkey % 120) / 5.0) AS BIGINT) % 4
    WHEN 0 THEN 'Lx/Src;.get:()V' WHEN 1 THEN 'Lx/Sink;.put:(I)V'
    WHEN 2 THEN 'Landroid/app/Activity;.startActivity:(Landroid/content/Intent;)V'
    ELSE 'Landroid/app/Activity;.findViewById:(I)Landroid/view/View;' END ELSE NULL END AS callee_sig,
  'Lcom/app/O' || CAST((l_suppkey * 120 + l_partkey % 120) % 7 AS STRING) || ';.m:()V' AS owner_sig
FROM {{lineitem}}"""

# A row of these tables takes few bytes of a file, so a task that reads a split has millions of rows, which the facts below
# multiply or compare: their rows are dealt to tasks by number before.
DEALT = {
    "part": ("p_partkey", {n for n, text in FACTS.items() if "{part}" in text}),
    "orders": ("o_orderkey", {"fx_listener_calls", "fx_register_calls"}),
}
DEALT_ROWS = 200_000
# Facts that are joined with themselves on some columns: their rows are dealt by these before equal ones are dropped, so that
# neither side of the join is dealt again.
JOINED_ON = {"fx_object_calls": ("app_id", "site_id")}

_SPREAD = re.compile(r"\$SPREAD\((\d+)\)")
_DEP = re.compile(r"(?<!\{)\{(\w+)\}")


def _spark_text(text: str) -> str:
    return _SPREAD.sub(
        lambda m: "LATERAL VIEW explode(array(" + ", ".join(map(str, range(int(m[1])))) + ")) sp AS k", text
    )


def _duck_text(text: str) -> str:
    text = _SPREAD.sub(lambda m: "CROSS JOIN (SELECT unnest([" + ", ".join(map(str, range(int(m[1])))) + "]) AS k) sp", text)
    return _DEP.sub(lambda m: m[1], text).replace("{{", "{")


class Facts:
    """Tables of one data folder, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._cache = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name in FACTS:
                text = FACTS[name]
                deps = {d: self._input(d, name) for d in dict.fromkeys(_DEP.findall(text))}
                if name in JOINED_ON:
                    rows = self.spark.sql(_spark_text(text.replace("SELECT DISTINCT", "SELECT", 1)), **deps)
                    self._cache[name] = rows.repartition(*JOINED_ON[name]).distinct()
                else:
                    self._cache[name] = self.spark.sql(_spark_text(text), **deps)
            else:
                self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[name]

    def _input(self, table: str, fact: str) -> DataFrame:
        """The table as ``fact`` reads it: the same rows, in tasks of at most some ``DEALT_ROWS``."""
        df = self[table]
        key, facts = DEALT.get(table, (None, ()))
        if fact not in facts:
            return df
        dealt = f"{table} dealt"
        if dealt not in self._cache:
            tasks = -(-df.count() // DEALT_ROWS)  # counted from the file's footers
            # By a hash that no join is on: joins after it keep their own, adaptive partitions.
            self._cache[dealt] = df.repartition(tasks, F.xxhash64(key)) if tasks > 1 else df
        return self._cache[dealt]


def with_facts(body: str) -> str:
    """Complete oracle SQL: the fact tables named as ``fx_…`` in ``body`` become leading WITH entries.

    ``body`` is a SELECT, or ``WITH …`` / ``WITH RECURSIVE …`` followed by one.
    """
    names: list[str] = []

    def need(text):
        for d in re.findall(r"\bfx_\w+", text):
            if d in FACTS and d not in names:
                need(FACTS[d])
                names.append(d)

    need(body)
    entries = ",\n".join(f"{n} AS ({_duck_text(FACTS[n])})" for n in names)
    body = body.strip()
    if not entries:
        return body
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(head):
            return f"{head}{entries},\n{body[len(head):]}"
    return f"WITH {entries}\n{body}"

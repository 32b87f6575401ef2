"""Fixed values.

Everything in this file is a platform name, signature, prefix or pattern that has to be spelled exactly so,
because results depend on it.  All lists are small and constant, so tables made from them may be broadcast.
"""

ACTIVITY, SERVICE, RECEIVER, PROVIDER = "ACTIVITY", "SERVICE", "RECEIVER", "PROVIDER"

# Precedence of component kinds when one name is declared under several.
KIND_PRECEDENCE = {ACTIVITY: 1, SERVICE: 2, RECEIVER: 3, PROVIDER: 4}

ANY = "ANY"

# --- inter-component calls: sub-signature -> kind of component it starts -----------------------------------------
ICC_SERVICE_SUBSIGS = [
    "startService:(Landroid/content/Intent;)Landroid/content/ComponentName;",
]
ICC_ACTIVITY_SUBSIGS = [
    "startActivity:(Landroid/content/Intent;)V",
    "startActivity:(Landroid/content/Intent;Landroid/os/Bundle;)V",
    "startActivityForResult:(Landroid/content/Intent;I)V",
    "startActivityForResult:(Landroid/content/Intent;ILandroid/os/Bundle;)V",
]
ICC_RECEIVER_SUBSIGS = [
    "sendBroadcast:(Landroid/content/Intent;)V",
    "sendBroadcast:(Landroid/content/Intent;Ljava/lang/String;)V",
    "sendBroadcastAsUser:(Landroid/content/Intent;Landroid/os/UserHandle;)V",
    "sendBroadcastAsUser:(Landroid/content/Intent;Landroid/os/UserHandle;Ljava/lang/String;)V",
    "sendOrderedBroadcast:(Landroid/content/Intent;Ljava/lang/String;)V",
    "sendOrderedBroadcast:(Landroid/content/Intent;Ljava/lang/String;Landroid/content/BroadcastReceiver;"
    "Landroid/os/Handler;ILjava/lang/String;Landroid/os/Bundle;)V",
    "sendOrderedBroadcastAsUser:(Landroid/content/Intent;Landroid/os/UserHandle;Ljava/lang/String;"
    "Landroid/content/BroadcastReceiver;Landroid/os/Handler;ILjava/lang/String;Landroid/os/Bundle;)V",
    "sendStickyBroadcast:(Landroid/content/Intent;)V",
    "sendStickyBroadcastAsUser:(Landroid/content/Intent;Landroid/os/UserHandle;)V",
    "sendStickyOrderedBroadcast:(Landroid/content/Intent;Landroid/content/BroadcastReceiver;"
    "Landroid/os/Handler;ILjava/lang/String;Landroid/os/Bundle;)V",
    "sendStickyOrderedBroadcastAsUser:(Landroid/content/Intent;Landroid/os/UserHandle;"
    "Landroid/content/BroadcastReceiver;Landroid/os/Handler;ILjava/lang/String;Landroid/os/Bundle;)V",
]
ICC_SUBSIGS = (
    [(s, SERVICE) for s in ICC_SERVICE_SUBSIGS]
    + [(s, ACTIVITY) for s in ICC_ACTIVITY_SUBSIGS]
    + [(s, RECEIVER) for s in ICC_RECEIVER_SUBSIGS]
)

REGISTER_RECEIVER_SUBSIGS = [
    "registerReceiver:(Landroid/content/BroadcastReceiver;Landroid/content/IntentFilter;)Landroid/content/Intent;",
    "registerReceiver:(Landroid/content/BroadcastReceiver;Landroid/content/IntentFilter;Ljava/lang/String;"
    "Landroid/os/Handler;)Landroid/content/Intent;",
]
FIND_VIEW_SIGS = [
    "Landroid/app/Activity;.findViewById:(I)Landroid/view/View;",
    "Landroid/view/View;.findViewById:(I)Landroid/view/View;",
]
SET_CONTENT_VIEW_SUBSIG = "setContentView:(I)V"
ENVIRONMENT_METHODS = ["envMain", "env"]
SENSITIVE_CALLBACK_PARAMS = ["android.location.Location", "android.content.Intent"]

# --- lifecycle methods per component kind -------------------------------------------------------------------------
LIFECYCLE_SUBSIGS = {
    ACTIVITY: [
        "onCreate:(Landroid/os/Bundle;)V",
        "onStart:()V",
        "onRestoreInstanceState:(Landroid/os/Bundle;)V",
        "onPostCreate:(Landroid/os/Bundle;)V",
        "onResume:()V",
        "onPostResume:()V",
        "onCreateDescription:()Ljava/lang/CharSequence;",
        "onSaveInstanceState:(Landroid/os/Bundle;)V",
        "onPause:()V",
        "onStop:()V",
        "onRestart:()V",
        "onDestroy:()V",
    ],
    SERVICE: [
        "onCreate:()V",
        "onStart:(Landroid/content/Intent;I)V",
        "onStartCommand:(Landroid/content/Intent;II)I",
        "onBind:(Landroid/content/Intent;)Landroid/os/IBinder;",
        "onRebind:(Landroid/content/Intent;)V",
        "onUnbind:(Landroid/content/Intent;)Z",
        "onDestroy:()V",
    ],
    RECEIVER: ["onReceive:(Landroid/content/Context;Landroid/content/Intent;)V"],
    PROVIDER: ["onCreate:()Z"],
}
COMPONENT_BASE_CLASSES = {
    "android.app.Activity": ACTIVITY,
    "android.app.Service": SERVICE,
    "android.content.BroadcastReceiver": RECEIVER,
    "android.content.ContentProvider": PROVIDER,
}

# --- class name prefixes ------------------------------------------------------------------------------------------
# Packages that count as library code, in the order in which they are given (one is given twice there).
LIBRARY_PREFIXES = """
android. dalvik. java. javax. junit. org.apache. org.json. org.w3c. org.xml. org.xmlpull. com.google. org.bouncycastle.
org.codehaus. com.flurry. com.actionbarsherlock. com.burstly.lib. com.chartboost.sdk. com.comscore. com.inmobi.
com.mobclix.android. oauth.signpost. org.acra. com.amazon. com.amazonaws. com.android.vending. com.millennialmedia.
com.tapjoy. com.mopub.mobileads. com.viewpagerindicator. com.adwhirl. com.urbanairship. org.slf4j. com.jumptap.adtag.
com.crittercism. com.applovin. com.greystripe. org.springframework. com.unity3d.player. com.admarvel. com.admob.
mediba.ad.sdk. com.adobe.air.
""".split()

# Fixed values.
THIRD_PARTY_PREFIXES = """
com.amazon. com.google. com.inmobi. com.millennialmedia. org.apache. com.adobe. com.android. com.facebook.
com.flurry. org.slf4j. com.admob. com.baidu. com.renren. com.mobfox. com.applovin. com.tapjoy. com.adwhirl.
com.badlogic. org.json. com.mongodb. com.appbrain. com.dropbox. com.github. com.twitter. com.umeng. com.netqin
""".split()

SUPPORT_LIBRARIES = {
    "android.support.v4": "support-v4",
    "android.support.v13": "support-v13",
    "android.support.v7": "appcompat-v7",
}

# --- API-misuse constants -----------------------------------------------------------------------------------------
CIPHER_GET_INSTANCE_SIGS = [
    "Ljavax/crypto/Cipher;.getInstance:(Ljava/lang/String;)Ljavax/crypto/Cipher;",
    "Ljavax/crypto/Cipher;.getInstance:(Ljava/lang/String;Ljava/lang/String;)Ljavax/crypto/Cipher;",
]
ECB_SCHEMES = [
    "AES",
    "DES",
    "DESede",
    "DES/ECB/NoPadding",
    "DESede/ECB/PKCS5Padding",
    "AES/ECB/PKCS5Padding",
    "DES/ECB/PKCS5Padding",
    "AES/ECB/NoPadding",
    "AES/ECB/PKCS7Padding",
]
SET_VERIFIER_SIG = (
    "Lorg/apache/http/conn/ssl/SSLSocketFactory;.setHostnameVerifier:"
    "(Lorg/apache/http/conn/ssl/X509HostnameVerifier;)V"
)
ALLOW_ALL_VERIFIER = "@@org.apache.http.conn.ssl.SSLSocketFactory.ALLOW_ALL_HOSTNAME_VERIFIER"
SET_COMPONENT_ENABLED_SUBSIG = "setComponentEnabledSetting:(Landroid/content/ComponentName;II)V"
LOG_INFO_SIG = "Landroid/util/Log;.i:(Ljava/lang/String;Ljava/lang/String;)I"

PERMISSION_CHECK_METHODS = """
checkCallingOrSelfPermission checkCallingPermission checkCallingUriPermission checkPermission checkUriPermission
enforceCallingPermission enforceCallingOrSelfPermission enforceCallingOrSelfUriPermission enforceCallingUriPermission
enforcePermission enforceUriPermission
""".split()
HARMLESS_NATIVE_CLASSES = ["android.util.Log", "android.os.SystemClock", "android.os.Binder"]

# --- corpus studies -----------------------------------------------------------------------------------------------
FEATURE_SUBSTRINGS = {
    "dynamic_loading": [";.loadClass:(Ljava/lang/String;)Ljava/lang/Class;"],
    "reflection": ["Ljava/lang/Class;.forName:", "java.lang.reflect."],
    "native_code": ["NATIVE {"],
}

# Identity-provider probes: (probe, needles in application code, needles in library code, counts as a login use)
PROVIDER_PROBES = [
    ("facebook_url", ["m.facebook.com"], ["m.facebook.com"], True),
    (
        "facebook_sdk_old",
        ["/Facebook;.authorize:", "/Facebook;.dialog:"],
        ["Lcom/facebook/android/Facebook;.authorize:", "Lcom/facebook/android/Facebook;.dialog:"],
        True,
    ),
    ("facebook_sdk_new", ["com.facebook.Session"], ["com.facebook.Session"], True),
    ("twitter_url", ["api.twitter.com/oauth"], ["api.twitter.com"], True),
    ("google_url", ["accounts.google.com"], ["accounts.google.com"], True),
    (
        "google_sdk",
        [
            "Lcom/google/android/gms/plus/PlusClient;.connect:",
            "Lcom/google/android/gms/auth/GoogleAuthUtil;.getToken:",
        ],
        [
            "Lcom/google/android/gms/plus/PlusClient;.connect:",
            "Lcom/google/android/gms/auth/GoogleAuthUtil;.getToken:",
        ],
        True,
    ),
    ("microsoft_url", [".live.com"], [".live.com"], True),
    ("linkedin_url", ["linkedin.com"], ["linkedin.com"], True),
    ("github_url", ["github.com"], ["github.com"], True),
    ("dropbox_url", ["dropbox.com"], ["dropbox.com"], True),
    ("webview", [".loadUrl:(Ljava/lang/String;"], [".loadUrl:(Ljava/lang/String;"], False),
    ("access_token", ["access_token"], ["access_token"], False),
]

AD_NETWORK_KEYS = """
adfonic winad admarvel appmedia smartadserver immob polar medialets baidu sense mads tapjoy innerActive zestadz admogo
smaato daum inmobi imobile flurry youmi airad mopub millennialmedia adchina mobclix adlib_android vpon mobfox casee
cauly adserver waps pontiflex googleads adwo adwhirl domob energysource madvertise madhouse qwapi mdotm guohead nexage
wiyun mobisage sktelecom vdopia adlocal admob greystripe uplusad adagogo jumptap everbadge microad mobgold yicha mobot
mediba moolah adknowledge transpera adview adlantis airpush leadbolt wqmobile wooboo
""".split()

# Login-text vocabulary; the four families are put together from these parts.  Repetitions are over character
# classes, not groups: a repeated group uses the stack for every character of a long text.
_PROVIDER = (
    r"(([Ff]acebook)|([tT]witter)|([gG]oogle)|([lL]ive)|([mM]icrosoft)|([tT]umblr)|([lL]inkedin)|([yY]ahoo)|([fF]lickr))"
)
_LOGIN = r"(([lL]og\s*in)|([sS]ign\s*on)|([rR]egister))"
_PREPOSITION = r"(([bB]y)|([wW]ith)|([uU]sing)|([vV]ia)|([tT]hrough))"
_SSO = r"((sso)|(SSO)|([sS]ingle\s*[sS]ign\s*[oO]n))"
_TOKEN = r"((token)|(Token)|(TOKEN))"
_CODE = r"((code)|(Code)|(CODE))"
_VERIFIER = r"(([vV]erifier)|([vV]eri)|([pP]in)|([pP]incode)|([pP]in\s*[cC]ode))"
_ACCESS = r"((access)|(Access)|(ACCESS)|([aA]uth)|([Aa]uthorization))"
_REQUEST = r"(([rR]eq)|([Rr]equest)|(REQUEST))"
_OAUTH = r"((OAuth)|(Oauth)|(oauth)|(OAUTH))"
_CONNECT = r"[\s_.]*"
LOGIN_PATTERNS = {
    "sso": (
        rf"(\b{_SSO}\b)|(\b{_PROVIDER}\s*([lL]ogin)\b)"
        rf"|\b({_LOGIN}\s+{_PREPOSITION}[\s\w]*\b{_PROVIDER}\b)"
    ),
    "oauth": rf"(\b({_ACCESS}{_CONNECT}{_TOKEN})|{_OAUTH}\b)",
    "oauth1": rf"(\b({_REQUEST}{_CONNECT}{_TOKEN})|(({_ACCESS}|{_OAUTH}){_CONNECT}{_VERIFIER})\b)",
    "oauth2_code": rf"(\b({_ACCESS}{_CONNECT}{_CODE})\b)",
}

# Host categories; a host is tested as a whole against each.
COMMON_SITES_PATTERN = (
    r".*(android|google|facebook|baidu|twitter|feedburner|jabber|foxnews|espn|apache|xml.org|youtube|gstatic|slf4j|"
    r"microsoft|washingtonpost|forbes|xmlsoap|xmlpull|htc|samsung|amazon|openxmlformats|sina)\..*"
)
AD_SITES_PATTERN = (
    r".*(adfonic|winad|admarvel|appmedia|smartadserver|immob|polar|medialets|baidu|sense|mads|tapjoy|innerActive|"
    r"zestadz|admogo|smaato|daum|inmobi|imobile|flurry|youmi|airad|mopub|millennialmedia|adchina|mobclix|"
    r"adlib_android|vpon|mobfox|casee|cauly|adserver|waps|pontiflex|googleads|adwo|adwhirl|domob|energysource|"
    r"madvertise|madhouse|qwapi|mdotm|guohead|nexage|wiyun|mobisage|sktelecom|vdopia|adlocal|admob|greystripe|"
    r"uplusad|adagogo|jumptap|everbadge|microad|mobgold|yicha|mobot|mediba|moolah|adknowledge|transpera|adview|"
    r"adlantis|airpush|leadbolt|wqmobile|wooboo)\..*"
)
ORG_SITES_PATTERN = r".*\.(com|org)"

# --- statement sources: every string of one group must occur in the literal ---------------------------------------
STATEMENT_SOURCES = {
    "COMMUNICATION_LEAKAGE": [["call_log", "calls"], ["icc", "adn"], ["com.android.contacts"], ["sms/"]],
    "OAUTH_TOKEN_TRACKING": [["content://call_log/calls"]],
}

# --- system services ----------------------------------------------------------------------------------------------
GET_SYSTEM_SERVICE_SUBSIG = "getSystemService:(Ljava/lang/String;)Ljava/lang/Object;"
SYSTEM_SERVICES = """
accessibility account activity alarm appwidget audio backup bluetooth clipboard connectivity country_detector
device_policy display download dropbox input_method input keyguard layout_inflater location media_router
network_management netpolicy netstats nfc notification servicediscovery power scheduling_policy search sensor serial
sip statusbar storage phone textservices throttle uimode updatelock usb user vibrator wallpaper wifip2p wifi window
""".split()

# --- intent-building calls: (sub-signature, argument, attribute, value kind, flag cleared when unresolved) ----------
# The intent itself is argument 0.  'uri' and 'component_name' arguments hold an instance that is resolved by a
# second pass over the calls that build those instances.
INTENT_CLASS = "Landroid/content/Intent;"
_CTX, _CLS, _STR, _URI = "Landroid/content/Context;", "Ljava/lang/Class;", "Ljava/lang/String;", "Landroid/net/Uri;"
_RET = "Landroid/content/Intent;"
INTENT_MODELS = [
    (f"<init>:({_CTX}{_CLS})V", 2, "component", "class", "explicit"),
    (f"<init>:({_STR})V", 1, "action", "string", "implicit"),
    (f"<init>:({_STR}{_URI})V", 1, "action", "string", "implicit"),
    (f"<init>:({_STR}{_URI})V", 2, "uri", "object", None),
    (f"<init>:({_STR}{_URI}{_CTX}{_CLS})V", 1, "action", "string", "implicit"),
    (f"<init>:({_STR}{_URI}{_CTX}{_CLS})V", 2, "uri", "object", None),
    (f"<init>:({_STR}{_URI}{_CTX}{_CLS})V", 4, "component", "class", "explicit"),
    (f"addCategory:({_STR}){_RET}", 1, "category", "string", "implicit"),
    (f"setAction:({_STR}){_RET}", 1, "action", "string", "implicit"),
    (f"setClass:({_CTX}{_CLS}){_RET}", 2, "component", "class", "explicit"),
    (f"setClassName:({_CTX}{_STR}){_RET}", 2, "component", "string", "explicit"),
    (f"setClassName:({_STR}{_STR}){_RET}", 2, "component", "string", "explicit"),
    (f"setComponent:(Landroid/content/ComponentName;){_RET}", 1, "component_name", "object", None),
    (f"setData:({_URI}){_RET}", 1, "uri", "object", None),
    (f"setDataAndNormalize:({_URI}){_RET}", 1, "uri", "object", None),
    (f"setDataAndType:({_URI}{_STR}){_RET}", 1, "uri", "object", None),
    (f"setDataAndType:({_URI}{_STR}){_RET}", 2, "mime", "string", "implicit"),
    (f"setDataAndTypeAndNormalize:({_URI}{_STR}){_RET}", 1, "uri", "object", None),
    (f"setDataAndTypeAndNormalize:({_URI}{_STR}){_RET}", 2, "mime", "string", "implicit"),
    (f"setType:({_STR}){_RET}", 1, "mime", "string", "implicit"),
    (f"setTypeAndNormalize:({_STR}){_RET}", 1, "mime", "string", "implicit"),
]
# Calls that build the helper instances: (signature, argument with the text, argument holding the instance,
# attribute, flag cleared when unresolved).  Argument -1 is the call's result.
HELPER_MODELS = [
    (f"{_URI}.parse:({_STR}){_URI}", 0, -1, "uri", "implicit"),
    (f"Landroid/content/ComponentName;.<init>:({_CTX}{_CLS})V", 2, 0, "component_name", "explicit"),
    (f"Landroid/content/ComponentName;.<init>:({_CTX}{_STR})V", 2, 0, "component_name", "explicit"),
    (f"Landroid/content/ComponentName;.<init>:({_STR}{_STR})V", 2, 0, "component_name", "explicit"),
]

PRIMITIVE_DESCRIPTORS = {
    "void": "V",
    "boolean": "Z",
    "byte": "B",
    "char": "C",
    "short": "S",
    "int": "I",
    "long": "J",
    "float": "F",
    "double": "D",
}

# --- listener types whose implementations are called back by the platform -----------------------------------------
LISTENER_TYPES = """
java.lang.CharSequence
android.accounts.OnAccountsUpdateListener
android.animation.Animator$AnimatorListener
android.animation.LayoutTransition$TransitionListener
android.animation.TimeAnimator$TimeListener
android.animation.ValueAnimator$AnimatorUpdateListener
android.app.ActionBar$OnMenuVisibilityListener
android.app.ActionBar$OnNavigationListener
android.app.ActionBar$TabListener
android.app.Application$ActivityLifecycleCallbacks
android.app.DatePickerDialog$OnDateSetListener
android.app.FragmentBreadCrumbs$OnBreadCrumbClickListener
android.app.FragmentManager$OnBackStackChangedListener
android.app.KeyguardManager$OnKeyguardExitResult
android.app.LoaderManager$LoaderCallbacks
android.app.PendingIntent$OnFinished
android.app.SearchManager$OnCancelListener
android.app.SearchManager$OnDismissListener
android.app.TimePickerDialog$OnTimeSetListener
android.bluetooth.BluetoothProfile$ServiceListener
android.content.ClipboardManager$OnPrimaryClipChangedListener
android.content.ComponentCallbacks
android.content.ComponentCallbacks2
android.content.DialogInterface$OnCancelListener
android.content.DialogInterface$OnClickListener
android.content.DialogInterface$OnDismissListener
android.content.DialogInterface$OnKeyListener
android.content.DialogInterface$OnMultiChoiceClickListener
android.content.DialogInterface$OnShowListener
android.content.IntentSender$OnFinished
android.content.Loader$OnLoadCanceledListener
android.content.Loader$OnLoadCompleteListener
android.content.SharedPreferences$OnSharedPreferenceChangeListener
android.content.SyncStatusObserver
android.database.Cursor
android.database.sqlite.SQLiteTransactionListener
android.drm.DrmManagerClient$OnErrorListener
android.drm.DrmManagerClient$OnEventListener
android.drm.DrmManagerClient$OnInfoListener
android.gesture.GestureOverlayView$OnGestureListener
android.gesture.GestureOverlayView$OnGesturePerformedListener
android.gesture.GestureOverlayView$OnGesturingListener
android.graphics.SurfaceTexture$OnFrameAvailableListener
android.hardware.Camera$AutoFocusCallback
android.hardware.Camera$AutoFocusMoveCallback
android.hardware.Camera$ErrorCallback
android.hardware.Camera$FaceDetectionListener
android.hardware.Camera$OnZoomChangeListener
android.hardware.Camera$PictureCallback
android.hardware.Camera$PreviewCallback
android.hardware.Camera$ShutterCallback
android.hardware.SensorEventListener
android.hardware.display.DisplayManager$DisplayListener
android.hardware.input.InputManager$InputDeviceListener
android.inputmethodservice.KeyboardView$OnKeyboardActionListener
android.location.GpsStatus$Listener
android.location.GpsStatus$NmeaListener
android.location.LocationListener
android.media.AudioManager$OnAudioFocusChangeListener
android.media.AudioRecord$OnRecordPositionUpdateListener
android.media.AudioRecord$OnRecordPositionUpdateListener
android.media.JetPlayer$OnJetEventListener
android.media.MediaPlayer$OnBufferingUpdateListener
android.media.MediaPlayer$OnCompletionListener
android.media.MediaPlayer$OnErrorListener
android.media.MediaPlayer$OnInfoListener
android.media.MediaPlayer$OnPreparedListener
android.media.MediaPlayer$OnSeekCompleteListener
android.media.MediaPlayer$OnTimedTextListener
android.media.MediaPlayer$OnVideoSizeChangedListener
android.media.MediaRecorder$OnErrorListener
android.media.MediaRecorder$OnInfoListener
android.media.MediaScannerConnection$MediaScannerConnectionClient
android.media.MediaScannerConnection$OnScanCompletedListener
android.media.SoundPool$OnLoadCompleteListener
android.media.audiofx.AudioEffect$OnControlStatusChangeListener
android.media.audiofx.AudioEffect$OnEnableStatusChangeListener
android.media.audiofx.BassBoost$OnParameterChangeListener
android.media.audiofx.EnvironmentalReverb$OnParameterChangeListener
android.media.audiofx.Equalizer$OnParameterChangeListener
android.media.audiofx.PresetReverb$OnParameterChangeListener
android.media.audiofx.Virtualizer$OnParameterChangeListener
android.media.audiofx.Visualizer$OnDataCaptureListener
android.media.effect.EffectUpdateListener
android.net.nsd.NsdManager$DiscoveryListener
android.net.nsd.NsdManager$RegistrationListener
android.net.nsd.NsdManager$ResolveListener
android.net.sip.SipRegistrationListener
android.net.wifi.p2p.WifiP2pManager$ActionListener
android.net.wifi.p2p.WifiP2pManager$ChannelListener
android.net.wifi.p2p.WifiP2pManager$ConnectionInfoListener
android.net.wifi.p2p.WifiP2pManager$DnsSdServiceResponseListener
android.net.wifi.p2p.WifiP2pManager$DnsSdTxtRecordListener
android.net.wifi.p2p.WifiP2pManager$GroupInfoListener
android.net.wifi.p2p.WifiP2pManager$PeerListListener
android.net.wifi.p2p.WifiP2pManager$ServiceResponseListener
android.net.wifi.p2p.WifiP2pManager$UpnpServiceResponseListener
android.os.CancellationSignal$OnCancelListener
android.os.IBinder$DeathRecipient
android.os.MessageQueue$IdleHandler
android.os.RecoverySystem$ProgressListener
android.preference.Preference$OnPreferenceChangeListener
android.preference.Preference$OnPreferenceClickListener
android.preference.PreferenceFragment$OnPreferenceStartFragmentCallback
android.preference.PreferenceManager$OnActivityDestroyListener
android.preference.PreferenceManager$OnActivityResultListener
android.preference.PreferenceManager$OnActivityStopListener
android.security.KeyChainAliasCallback
android.speech.RecognitionListener
android.speech.tts.TextToSpeech$OnInitListener
android.speech.tts.TextToSpeech$OnUtteranceCompletedListener
android.view.ActionMode$Callback
android.view.ActionProvider$VisibilityListener
android.view.GestureDetector$OnDoubleTapListener
android.view.GestureDetector$OnGestureListener
android.view.InputQueue$Callback
android.view.KeyEvent$Callback
android.view.MenuItem$OnActionExpandListener
android.view.MenuItem$OnMenuItemClickListener
android.view.ScaleGestureDetector$OnScaleGestureListener
android.view.SurfaceHolder$Callback
android.view.SurfaceHolder$Callback2
android.view.TextureView$SurfaceTextureListener
android.view.View$OnAttachStateChangeListener
android.view.View$OnClickListener
android.view.View$OnCreateContextMenuListener
android.view.View$OnDragListener
android.view.View$OnFocusChangeListener
android.view.View$OnGenericMotionListener
android.view.View$OnHoverListener
android.view.View$OnKeyListener
android.view.View$OnLayoutChangeListener
android.view.View$OnLongClickListener
android.view.View$OnSystemUiVisibilityChangeListener
android.view.View$OnTouchListener
android.view.ViewGroup$OnHierarchyChangeListener
android.view.ViewStub$OnInflateListener
android.view.ViewTreeObserver$OnDrawListener
android.view.ViewTreeObserver$OnGlobalFocusChangeListener
android.view.ViewTreeObserver$OnGlobalLayoutListener
android.view.ViewTreeObserver$OnPreDrawListener
android.view.ViewTreeObserver$OnScrollChangedListener
android.view.ViewTreeObserver$OnTouchModeChangeListener
android.view.accessibility.AccessibilityManager$AccessibilityStateChangeListener
android.view.animation.Animation$AnimationListener
android.view.inputmethod.InputMethod$SessionCallback
android.view.inputmethod.InputMethodSession$EventCallback
android.view.textservice.SpellCheckerSession$SpellCheckerSessionListener
android.webkit.DownloadListener
android.webkit.WebViewClient
android.widget.AbsListView$MultiChoiceModeListener
android.widget.AbsListView$OnScrollListener
android.widget.AbsListView$RecyclerListener
android.widget.AdapterView$OnItemClickListener
android.widget.AdapterView$OnItemLongClickListener
android.widget.AdapterView$OnItemSelectedListener
android.widget.AutoCompleteTextView$OnDismissListener
android.widget.CalendarView$OnDateChangeListener
android.widget.Chronometer$OnChronometerTickListener
android.widget.CompoundButton$OnCheckedChangeListener
android.widget.DatePicker$OnDateChangedListener
android.widget.ExpandableListView$OnChildClickListener
android.widget.ExpandableListView$OnGroupClickListener
android.widget.ExpandableListView$OnGroupCollapseListener
android.widget.ExpandableListView$OnGroupExpandListener
android.widget.Filter$FilterListener
android.widget.NumberPicker$OnScrollListener
android.widget.NumberPicker$OnValueChangeListener
android.widget.PopupMenu$OnDismissListener
android.widget.PopupMenu$OnMenuItemClickListener
android.widget.PopupWindow$OnDismissListener
android.widget.RadioGroup$OnCheckedChangeListener
android.widget.RatingBar$OnRatingBarChangeListener
android.widget.SearchView$OnCloseListener
android.widget.SearchView$OnQueryTextListener
android.widget.SearchView$OnSuggestionListener
android.widget.SeekBar$OnSeekBarChangeListener
android.widget.ShareActionProvider$OnShareTargetSelectedListener
android.widget.SlidingDrawer$OnDrawerCloseListener
android.widget.SlidingDrawer$OnDrawerOpenListener
android.widget.SlidingDrawer$OnDrawerScrollListener
android.widget.TabHost$OnTabChangeListener
android.widget.TextView$OnEditorActionListener
android.widget.TimePicker$OnTimeChangedListener
android.widget.ZoomButtonsController$OnZoomListener
android.bluetooth.BluetoothAdapter$LeScanCallback
android.bluetooth.BluetoothProfile$ServiceListener
android.nfc.NfcAdapter$CreateNdefMessageCallback
android.nfc.NfcAdapter$OnNdefPushCompleteCallback
""".split()

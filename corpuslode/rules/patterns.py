"""Pattern rules: framework constructs to be located and counted.

``value`` (capture ``group``) names the occurrence unless ``name`` is fixed.
"""

from __future__ import annotations

from ..functions.blocks import Block
from .access import OPTIONS
from .injection import BARE_CALL
from .model import Rule, has, numbered

REACT, MOBILE, VUE = ("react", "react-native", "expo"), ("react-native", "expo"), ("vue3", "nuxt3")

# Names by occurrence type.
STANDARD_HOOKS = [
    "useState", "useEffect", "useContext", "useReducer", "useCallback", "useMemo", "useRef",
    "useImperativeHandle", "useLayoutEffect", "useDebugValue",
]
FETCH_NAMES = ["fetch", "axios", "useFetch", "useAsyncData", "$fetch", "useQuery", "useMutation"]
FORM_NAMES = ["useForm", "Formik", "useFormik", "Controller", "FormProvider"]
NAVIGATORS = [
    "createStackNavigator", "createBottomTabNavigator", "createDrawerNavigator",
    "createNativeStackNavigator", "createMaterialTopTabNavigator",
]
NAVIGATION_HOOKS = ["useNavigation", "useRoute", "useFocusEffect", "useIsFocused"]
ANIMATED_CALLS = [
    "useSharedValue", "useAnimatedStyle", "useDerivedValue", "withTiming", "withSpring", "withDecay", "runOnJS", "runOnUI",
]
PERMISSION_CALLS = [
    "request", "check", "checkMultiple", "requestMultiple", "openSettings", "checkNotifications", "requestNotifications",
]
STORAGE_CALLS = ["getItem", "setItem", "removeItem", "clear", "getAllKeys", "multiGet", "multiSet"]
GESTURE_TAGS = [
    "PanGestureHandler", "TapGestureHandler", "LongPressGestureHandler", "RotationGestureHandler",
    "PinchGestureHandler", "Swipeable",
]
GESTURE_HOOKS = ["useAnimatedGestureHandler", "Gesture"]
MEDIA_CALLS = ["launchImageLibrary", "launchCamera", "openPicker", "openCamera", "ImagePicker", "Camera"]
MEDIA_TAGS = ["Video", "Audio", "Camera"]
ROUTE_METHODS = ["get", "post", "put", "delete", "patch", "options", "head"]
ROUTE_HOOKS = ["onRequest", "preHandler", "preParsing", "preValidation"]
LIFECYCLE_HOOKS = [
    "onRequest", "preParsing", "preValidation", "preHandler", "preSerialization", "onSend", "onResponse", "onError", "onTimeout",
]
QUERY_WORDS = ["SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP"]
STREAM_SOURCES = [("fromKafka", "kafka"), ("fromArray", "array"), ("fromStream", "stream")]
STREAM_OPERATORS = [
    "map", "filter", "fn", "fnRaw", "each", "keyBy", "withEventTime", "groupBy", "sumMap", "branch", "aggregate", "toStorage",
]
STREAM_WINDOWS = ["slidingWindowTime", "tumblingWindowTime", "sessionWindow"]
STREAM_STORES = ["toStorage", "aggregate"]


def any_of(names) -> str:
    return "|".join(n.replace("$", r"\$") for n in names)


def _calls(names) -> str:
    return BARE_CALL + rf"({any_of(names)})\s*(?:<[^()]*>)?\s*\("


def _calls_with(parts) -> str:
    # The whole name is taken at once, so a long one is read once.
    return BARE_CALL + rf"(?=[\w$]*?(?:{any_of(parts)}))([\w$]++)\s*(?:<[^()]*>)?\s*\("


def _member(owner: str, names=None) -> str:
    return rf"(?:^|[^.\w$])({owner}\.(?:{any_of(names) if names else r'[A-Za-z_$][\w$]*'}))\b"


def _tag(names) -> str:
    return rf"<({any_of(names)})\b"


def _p(kind, confidence, pattern, frameworks=(), gate=(), group=1, **extra) -> Rule:
    return Rule(
        rule_id="", family="patterns", title=kind, kind=kind, category=kind, confidence=confidence, pattern=pattern,
        on="code", group=group, frameworks=frameworks, gate=gate, status="", snippet="none", **extra,
    )


RULES = numbered("PAT", [
    # react, react native, expo
    _p("hooks", 1.0, BARE_CALL + rf"({any_of(STANDARD_HOOKS)})\s*(?:<[^()]*>)?\s*\(", REACT, ("use",)),
    _p("custom-hooks", 0.9, BARE_CALL + r"(use\w+)\s*(?:<[^()]*>)?\s*\(", REACT, ("use",),
       drop_rx=rf"^(?:{any_of(STANDARD_HOOKS)})$"),
    _p("hoc", 1.0, r"\bfunction\s+(with\w*)\s*\(\s*[A-Za-z_${\[]", REACT, ("function", "with")),
    _p("render-props", 1.0, r"\s(render|children)\s*=\s*\{\s*(?:async\s+)?(?:function\b|\([^()]*\)\s*=>|\w+\s*=>)", REACT),
    _p("compound-components", 1.0, r"(?m)^[ \t]*([A-Za-z_$][\w$]*\.[A-Za-z_$][\w$]*)\s*=[^=>]", REACT),
    _p("providers", 0.95, BARE_CALL + r"(createContext)\s*(?:<[^()]*>)?\s*\(", REACT, ("createcontext",), name="ContextProvider"),
    _p("providers", 1.0, r"<(\w+\.Provider)\b", REACT, (".provider",)),
    # mobile
    _p("rn-navigation", 1.0, _calls(NAVIGATORS + NAVIGATION_HOOKS), MOBILE),
    _p("rn-platform-specific", 1.0, _member("Platform", ["OS", "select", "Version"]), MOBILE, ("platform.",)),
    _p("rn-native-modules", 0.95, _member("NativeModules"), MOBILE, ("nativemodules.",)),
    _p("rn-native-modules", 1.0, r"\bnew\s+(NativeEventEmitter|TurboModuleRegistry)\b", MOBILE, ("new",)),
    _p("rn-animations", 1.0, _calls(ANIMATED_CALLS), MOBILE),
    _p("rn-animations", 0.9, _member("Animated"), MOBILE, ("animated.",)),
    _p("rn-animations", 1.0, r"""(?m)^[ \t]*['"](worklet)['"]""", MOBILE, ("worklet",)),
    _p("rn-permissions", 1.0, _member("Permissions", PERMISSION_CALLS), MOBILE, ("permissions.",)),
    _p("rn-permissions", 0.9, r"\w\.(Permissions)\.\w", MOBILE, (".permissions.",), name="Expo.Permissions"),
    _p("rn-storage", 1.0, _member("AsyncStorage", STORAGE_CALLS), MOBILE, ("asyncstorage.",)),
    _p("rn-storage", 0.9, r"(?:^|[^.\w$])((?:MMKV|\w*storage\w*)\.(?:set|getString|delete))\b", MOBILE, (), name="MMKV"),
    _p("rn-storage", 1.0, _member("SecureStore"), MOBILE, ("securestore.",), name="SecureStore"),
    _p("rn-gestures", 1.0, _tag(GESTURE_TAGS), MOBILE),
    _p("rn-gestures", 1.0, _calls(GESTURE_HOOKS), MOBILE),
    _p("rn-media", 0.95, _calls_with(MEDIA_CALLS), MOBILE),
    _p("rn-media", 1.0, _tag(MEDIA_TAGS), MOBILE),
    # vue, nuxt
    _p("composables", 0.95, r"\b(?:function|const|let|var)\s+(use[\w$]*)\s*[=(<]", VUE, ("use",)),
    _p("pinia-stores", 1.0, r"""\bdefineStore\s*\(\s*['"]([^'"\n]*)['"]""", VUE, ("definestore",),
       block=Block(link=r"\s*,\s*", levels=3)),
    _p("vue-plugins", 1.0, r"\bexport\s+default\s+\{[^}]*?\b(install)\s*[(:,]", VUE, ("install",)),
    _p("vue-directives", 1.0, r"""\.directive\s*\(\s*['"]([^'"\n]+)['"]""", VUE, (".directive",)),
    _p("nuxt-modules", 1.0, r"\b(defineNuxtModule)\s*(?:<[^()]*>)?\s*\(", ("nuxt3",), ("definenuxtmodule",)),
    _p("nuxt-middleware", 1.0, r"\bexport\s+(default)\s+(?:async\s+)?(?:function\b|\(|\w+\s*=>)", ("nuxt3",), ("default",),
       where=(has(path=["/middleware/"]),)),
    # fastify
    _p("fastify-routes", 1.0,
       rf"""\.(?i:({any_of(ROUTE_METHODS)}))\s*\(\s*['"`][^'"`\n]*['"`]\s*""", ("fastify",), block=OPTIONS),
    _p("fastify-routes", 1.0, r"\.(route)\s*\(\s*", ("fastify",), (".route",), block=Block(required=True)),
    _p("fastify-plugins", 1.0, r"\.register\s*\(\s*((?:async\s+)?(?:function\b|\(|[\w$]+))", ("fastify",), (".register",)),
    _p("fastify-plugins", 1.0, BARE_CALL + r"(fp|fastifyPlugin)\s*\(", ("fastify",)),
    _p("fastify-hooks", 1.0, rf"""\.addHook\s*\(\s*['"]({any_of(LIFECYCLE_HOOKS)})['"]""", ("fastify",), (".addhook",)),
    _p("fastify-hooks", 0.9, rf"(?:[{{,]\s*)({any_of(LIFECYCLE_HOOKS)})\s*:", ("fastify",)),
    _p("postgres-queries", 1.0,
       r"""\.(query)\s*\(\s*(?:`[^`]*`|"[^"\n]*"|'[^'\n]*'|[\w.$]+)\s*[,)]?""", ("fastify",), (".query",)),
    _p("kafka-producers", 1.0, r"\b((?i:\w*producer\w*))\.send\s*\(\s*", ("fastify",), (".send",), block=Block(levels=2)),
    _p("kafka-consumers", 1.0, r"\b((?i:\w*consumer\w*))\.subscribe\s*\(\s*", ("fastify",), (".subscribe",), block=Block(levels=2)),
    _p("stream-tasks", 1.0, r"\b(?:new\s+)?(Task)\s*\([^()]*\)(?:\s*\.\w+\s*\([^;]*)?", ("fastify",), ("task",)),
    # every framework
    _p("data-fetching", 0.9, _calls_with(FETCH_NAMES)),
    _p("error-handling", 1.0, r"\b(try)\s*\{", (), ("try",), name="try-catch"),
    _p("error-handling", 0.95, r"\bclass\s+(\w*ErrorBoundary\w*)", (), ("errorboundary",)),
    _p("forms", 0.9, _calls_with(FORM_NAMES)),
    _p("forms", 0.8, r"<(form)\b", (), ("<form",), name="native-form"),
])
